from __future__ import annotations

import random
import re

import numpy as np

from latticework.llm.common import picked
from latticework.llm import minhash
from latticework.llm.common import Scratch, connected_components
from latticework.llm.shingles import shingle_sets


def exact_sets(texts):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """(doc_id, text) -> component by comparing all pairs; rows of one id are one node."""
    rows = [(d, s) for (d, _), s in zip(rows, exact_sets([t for _, t in rows]), strict=True) if d is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(rows):
        for b, sb in rows[:i]:
            shared = len(sa & sb)
            if shared and 100 * shared >= 75 * (len(sa) + len(sb) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_edges_match_brute_force(edges, none):
    rows = picked(edges, doc_id=("doc_id", None), text=("text", None)).collect()
    want = brute([tuple(r) for r in rows])
    got = minhash.near_duplicates(edges).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    sizes = {len(s) for s in exact_sets([r["text"] for r in rows])}
    assert {r["n_shingles"] for r in got} == sizes
    assert minhash.near_duplicates(none).count() == 0


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_large_groups_go_through_many_tiles(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(60):
            n = 2000
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
            got, used = minhash.estimates(minhash.registers(a), minhash.registers(b), np.array([len(a)]), np.array([len(b)]))
            errors.append(float(np.ravel(got)[0]) - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_empty_registers_and_threshold_cases():
    assert not minhash.registers(np.empty(0, np.uint64)).any()
    # 3 of 4 shingles shared by both: exactly at the threshold
    a = "a b c d e f g"  # 3 shingles
    b = "a b c d e f g h"  # 4 shingles
    assert brute([(1, a), (2, b)]) == {1: 1, 2: 1}


def test_threshold_is_inclusive(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "q r s t u v"), (4, "q r s t u v w")]  # 3/4 and 2/3
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_shingles_of_long_and_grouped_texts_agree():
    rng = random.Random(9)
    texts = ["", None, "a", "ab cd", *(" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(0, 300))) for _ in range(50)), "word " * 100_000]
    for t, found, want in zip(texts, shingle_sets(texts), exact_sets(texts), strict=True):
        assert len(found) == len(want), (t or "")[:50]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(300, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 40), 1)}


def test_dropping_keeps_one_row_of_each_component(edges):
    kept = minhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    want = brute([tuple(r) for r in picked(edges, doc_id=("doc_id", None), text=("text", None)).collect()])
    assert set(ids) == set(want.values())
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_unrelated_texts_of_one_doc_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 0), (2, b, 2), (2, b, 1), (2, c, 0), (2, None, 0), (2, None, 0), (3, f"{c} end", 0), (3, a, 5), (3, None, 0), (None, a, 0), (None, a, 0)]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    # c of 3 is near c of 2, a of 3 is a of 1, and nothing is near a null
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a, 0), (2, b, 1), (2, c, 0), (2, None, 0), (3, None, 0), (None, a, 0), (None, a, 0)], key=repr)


def test_of_linked_texts_of_one_doc_id_one_stays(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(7, f"{a} x"), (7, a), (9, f"{a} y")]
    assert [tuple(r) for r in minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [(7, a)]


def test_three_of_four_shingles_are_linked_without_a_band(spark):
    rows = []
    for i, word in enumerate(("e10884", "e41626")):
        a = f"a b c d {word} f g"
        few, more = shingle_sets([a, f"{a} h"])
        assert (len(few), len(more)) == (3, 4)
        assert not set(minhash.band_keys(minhash.registers(few))) & set(minhash.band_keys(minhash.registers(more)))
        rows += [(2 * i, a), (2 * i + 1, f"{a} h")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {0: 0, 1: 0, 2: 2, 3: 2}
