from __future__ import annotations

import json
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from latticework.operators.cube import States, cube, cube_states, finalize, merged, projected
from latticework.plans.spec import Bind, Filter, Ignore, SpecError, Target

TARGETS = [
    Target("s", "SUM", value="n"), Target("hi", "MAX", value="n"), Target("lo", "MIN", value="n"), Target("mean", "AVG", value="n"), Target("dist", "VALUEDIST", "0", "word"), Target("top", "VALUEDIST", "2", "word"),
    Target("ranges", "RANGEDIST", "-5~3~10", "n"), Target("users", "UVBITMAP", value="user"), Target("h", "UV_HYPERLOGLOG", value="user"), Target("hpp", "UV_HYPERLOGLOGPLUS", value="user"),
]
SCHEMA = "a string, b string, c string, n int, word string, user long"


def rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", "ALL", "", None]), rng.choice("pq"), rng.choice("uvw"), rng.choice([None, *range(-9, 15)]), rng.choice(["k", 'q"\\', "é", "EMPTY", None]), rng.choice([None, -3, *range(40), 10**9])) for _ in range(n)]


def brute(data, rules_apply=lambda key, up: True, sets=None):
    dims = ("a", "b", "c")
    groups = defaultdict(list)
    for r in data:
        key = tuple("EMPTY" if v is None else v for v in r[:3])
        for up in sets if sets is not None else [u for k in range(4) for u in combinations(dims, k)]:
            if rules_apply(dict(zip(dims, key, strict=True)), up):
                groups[tuple("ALL" if d in up else v for d, v in zip(dims, key, strict=True))].append(r)
    out = {}
    for key, some in groups.items():
        n = [r[3] for r in some if r[3] is not None]
        counts = defaultdict(int)
        for r in some:
            if r[4] is not None:
                counts[r[4]] += 1
        order = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        ranges = defaultdict(int)
        for v in n:
            ranges[0 if v < -5 else 6 if v > 10 else int(v / 3) + 1] += 1
        out[key] = (sum(n) if n else None, max(n, default=None), min(n, default=None), round(sum(n) / len(n), 9) if n else None, order, order[:2], sorted(ranges.items()), len({r[5] for r in some if r[5] is not None and r[5] >= 0}))
    return out


def shown(df):
    out = {}
    for r in df.collect():
        head, _, tail = (r["ranges"] or "").partition(",{")
        assert not r["ranges"] or head == "min:-5.0,interval:3.0,max:10.0"
        dist = json.loads(r["dist"] or "{}", object_pairs_hook=list) or []
        out[r["a"], r["b"], r["c"]] = (r["s"], r["hi"], r["lo"], None if r["mean"] is None else round(r["mean"], 9), dist, json.loads(r["top"] or "{}", object_pairs_hook=list) or [], [(int(k), v) for k, v in json.loads("{" + tail, object_pairs_hook=list)] if tail else [], r["users"] or 0)
        exact = r["users"] or 0
        for sketch in ("h", "hpp"):
            assert abs((r[sketch] or 0) - exact) <= 2  # the sketch also counts the one negative id
    return out


@pytest.fixture(scope="module")
def data():
    return rows()


def test_every_metric_in_every_roll_up(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert shown(cube(df, ["c", "a", "b"], TARGETS)) == brute(data)


def test_without_the_base_cuboid(spark, data):
    dims = ["a", "b", "c"]
    rows_ = projected(spark.createDataFrame(data, SCHEMA), dims, TARGETS)
    rules = [Filter("b", "WList", ("p",))]
    assert shown(finalize(cube_states(rows_, dims, TARGETS, rules, pre_aggregate=False))) == brute(data, lambda k, u: "b" not in u or k["b"] == "p")


@pytest.mark.parametrize(
    ("rules", "sets", "passes"),
    [
        ([Ignore(("a", "b", "c"))], [()], lambda k, u: True),
        ([Bind(("b", "a"))], [(), ("a", "b"), ("c",), ("a", "b", "c")], lambda k, u: True),
        ([Filter("b", "WList", ("p",))], None, lambda k, u: "b" not in u or k["b"] == "p"),
        ([Filter("c", "BList", ("u", "w"))], None, lambda k, u: "c" not in u or k["c"] == "v"),
        ([Filter("c", "WList", ("p\tu", "q\tv"), related="b")], [(), ("a",), ("c",), ("a", "c")], lambda k, u: "c" not in u or k["b"] + k["c"] in ("pu", "qv")),
        ([Filter("c", "BList", ("p\tu",), related="b"), Filter("a", "BList", ("x",))], [(), ("a",), ("c",), ("a", "c")], lambda k, u: ("c" not in u or k["b"] + k["c"] != "pu") and ("a" not in u or k["a"] != "x")),
    ],
)
def test_rules(spark, data, rules, sets, passes):
    assert shown(cube(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"], TARGETS, rules)) == brute(data, passes, sets)


def test_configured_lists_as_list_table_and_empty(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    rule = [Filter("b", "WList", config="l")]
    want = brute(data, lambda k, u: "b" not in u or k["b"] == "p")
    for listed in (["p"], spark.createDataFrame([("p",), ("p",), (None,)], "v string")):
        assert shown(cube(df, ["a", "b", "c"], TARGETS, rule, {"l": listed})) == want
    assert shown(cube(df, ["a", "b", "c"], TARGETS, rule, {"l": []})) == brute(data, lambda k, u: "b" not in u)
    with pytest.raises(SpecError):
        cube(df, ["a", "b", "c"], TARGETS, rule, {})


def test_chunks_merge_to_the_whole(spark, data):
    dims = ["a", "b", "c"]
    parts = [cube_states(projected(spark.createDataFrame(data[i::3], SCHEMA), dims, TARGETS), dims, TARGETS) for i in range(3)]
    whole = parts[0]
    for p in parts[1:]:
        whole = States(dims, whole.targets, whole.rows.unionByName(p.rows))
    assert shown(finalize(merged(whole))) == brute(data)


def test_all_row_is_the_sum_of_the_others(spark, data):
    df = spark.createDataFrame([r for r in data if r[0] != "ALL"], SCHEMA)
    out = cube(df, ["a", "b"], [Target("s", "SUM", value="coalesce(n, 0)")])
    assert out.where("a = 'ALL' and b = 'ALL'").first()["s"] == out.where("a <> 'ALL' and b <> 'ALL'").agg(F.sum("s")).first()[0]


def test_types_widen_and_missing_targets_are_null(spark):
    df = spark.createDataFrame([("x", 2**31 - 1, 1.5, None), ("x", 2**31 - 1, 2.5, None)], "d string, i int, f float, m int")
    out = cube(df, ["d"], [Target("i", "SUM"), Target("f", "SUM"), Target("m", "SUM"), Target("avg", "AVG", value="m"), Target("uv", "UVBITMAP", value="m"), Target("text", "MAX", value="'7'")])
    assert dict(out.dtypes) == {"d": "string", "i": "bigint", "f": "double", "m": "bigint", "avg": "double", "uv": "bigint", "text": "double"}
    assert {(r["i"], r["f"], r["m"], r["avg"], r["uv"], r["text"]) for r in out.collect()} == {(2**32 - 2, 4.0, None, None, None, 7.0)}


def test_empty_input_has_no_rows(spark):
    assert cube(spark.createDataFrame([], SCHEMA), ["a", "b", "c"], TARGETS).count() == 0


def test_one_shuffle_each_for_base_and_cube(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    plan = cube(df, ["a", "b", "c"], [Target("s", "SUM", value="n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan and "Window" not in plan


def test_all_metrics_in_one_scan(spark, sf):
    from latticework import queries

    for query, shuffles in ((queries.uv_bitmap_many, 3), (queries.flagship, 3), (queries.uv_hll_bound, 3), (queries.QUERIES["rollup_hour_day"], 5)):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == shuffles and "Join" not in plan and "Python" not in plan
    top = queries.metric_valuedist_top(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert top.count("FileScan") == 1 and top.count("WindowGroupLimit") == 2  # before the shuffle and after it
