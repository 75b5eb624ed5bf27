from __future__ import annotations

import math
import re
from collections import defaultdict

import pytest

from latticework.llm import mixing


def brute_targets(sizes):
    """source -> target, by sharing what capped sources leave until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(df):
    rows = mixing.mix_report(df).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert len(rows) == len(texts)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in texts:
        total[s] += size(t)
    want = brute_targets(total)
    assert sorted((str(d), size(t), total[s]) for d, t, s in texts) == sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in rows)
    assert sorted(round(want[s], 6) for _, _, s in texts) == pytest.approx(sorted(r["target"] for r in rows))
    for r in rows:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(df.repartition(5)).collect()))
    return rows


def test_edges(edges, none):
    check(edges)
    assert mixing.mix_report(none).count() == 0
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix_report(edges).collect())


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = check(docs)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.05 * t


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(0, "a b c", "a", 0)] + [(i, "w " * 50, "b", 0) for i in range(1, 60)] + [(100, "x y", None, 0)]
    got = {r["doc_id"]: r for r in check(spark.createDataFrame(rows, "doc_id long, text string, source string, size int"))}
    assert got[0]["taken"] == 9 and got[0]["target"] == 9.0
    assert got[100]["target"] == 6.0


def test_all_sizes_zero(spark):
    got = check(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string"))
    assert {r["target"] for r in got} == {0.0}
