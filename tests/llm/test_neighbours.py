from __future__ import annotations

import numpy as np

from latticework.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, ids int"


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = found[:k]
    return out


def check(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = {}
    for r in neighbours.nearest(df, k=k, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {q: v for q, v in brute(rows, k).items() if v}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q, v in got.items():
        np.testing.assert_allclose([s for s, _ in v], [s for s, _ in want[q]], rtol=1e-12)


def vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32).astype(float).tolist()


def test_matches_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    check(spark, list(enumerate(vectors(600, 16, 1))))


def test_ties_and_copies_go_by_id(spark):
    v = vectors(3, 4, 2)
    check(spark, [(i, v[i % 3]) for i in range(301)])


def test_bad_vectors_take_no_part(spark):
    v = vectors(30, 4, 3)
    bad = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 4.0]]
    rows = list(enumerate(v)) + [(100 * (i + 1), b) for i, b in enumerate(bad)] + [(None, v[0])]
    check(spark, rows)


def test_few_and_no_candidates(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.5])])
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [])


def test_extreme_scales(spark):
    rng = np.random.default_rng(4)
    scale = 10.0 ** rng.integers(-6, 7, 300)
    v = (rng.normal(size=(300, 8)) * scale[:, None]).astype(np.float32).astype(float).tolist()
    check(spark, list(enumerate(v)))


def test_values_beyond_the_range_of_squares(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [3.0, 4.0]), (3, [5e-324, 0.0]), (100, [0.0, 1e-320])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    inf = float("inf")
    assert got == [(0, 1, 1.0), (0, 2, inf), (0, 3, inf), (0, 100, inf), (100, 3, 0.0), (100, 2, 5.0), (100, 0, inf), (100, 1, inf)]


def test_a_repeated_query_id_answers_for_its_least_vector(spark):
    rows = [(100, [5.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        assert [(r["vec_id"], r["score"]) for r in neighbours.nearest(df).collect()] == [(7, 1.0)]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 32)), rng.normal(size=(50, 32))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    keep = neighbours.survivors(neighbours.quantise(a), neighbours.quantise(b), np.zeros((20, 50), bool), 5)
    for i in range(20):
        assert keep[i][np.argsort(true[i])[:5]].all()
    assert keep.sum() < 0.5 * keep.size  # the bounds prune


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for _, i in v] for q, v in brute(rows, 10).items()}
