from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticework.llm import packing


def plain_best_fit(lengths, capacity, open_bins):
    """The same rule without a bitset: a list of open bins, searched through."""
    bins, open_, out = 0, [], []  # open_: [free, age, bin]
    for n, length in enumerate(lengths):
        fit = [b for b in open_ if b[0] >= length]
        if fit:
            least = min(b[0] for b in fit)
            chosen = max((b for b in fit if b[0] == least), key=lambda b: b[1])
            open_.remove(chosen)
        else:
            chosen = [capacity, 0, bins]
            bins += 1
        out.append((chosen[2], capacity - chosen[0]))
        if chosen[0] > length:
            open_.append([chosen[0] - length, n, chosen[2]])
        if len(open_) > open_bins:
            least = min(b[0] for b in open_)
            open_.remove(max((b for b in open_ if b[0] == least), key=lambda b: b[1]))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=200), st.integers(1, 6))
def test_bitset_is_plain_best_fit(lengths, open_bins):
    assert list(packing.best_fit(lengths, 32, open_bins)) == plain_best_fit(lengths, 32, open_bins)


def test_cuts():
    assert packing.cuts(1) == [(0, 1)]
    assert packing.cuts(1024) == [(0, 1024)]
    assert packing.cuts(1025) == [(0, 1), (1, 1024)]
    assert packing.cuts(3000) == [(0, 952), (952, 1024), (1976, 1024)]


@pytest.mark.parametrize("text", ["", "<|endoftext|> a", "x<|endoftext|>", "     é漢🙂\n\n\t", "a" * 20_000, "don't we'll 12345 !!! \r\n", "\u0085​᠎"])
def test_fast_ids_are_the_tokenizers(text):
    paths = packing.vocabulary()
    slow = Tokenizer.from_file(paths[0])
    assert list(packing.encoder(*paths)(text)) == slow.encode(text, add_special_tokens=False).ids


def check(rows, docs):
    slow = Tokenizer.from_file(packing.vocabulary()[0])
    want = defaultdict(list)
    for d, text in docs:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want[d] += [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cuts(len(ids)))]
    got, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return len(placed)


def test_many_equal_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 1000)
    monkeypatch.setattr(packing, "RUN", 50)
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'the same text again' as text")
    rows = packing.pack(docs).collect()
    tasks = Counter(r["sequence_id"] >> 40 for r in rows)
    assert len(tasks) == 4 and max(tasks.values()) < 1600
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4000


def test_the_result_does_not_depend_on_batches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append({(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in packing.pack(docs).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]


@pytest.mark.parametrize("run", [" ", " \n", "1", "a"])
def test_runs_of_millions_have_the_tokenizers_ids(run):
    paths = packing.vocabulary()
    slow = Tokenizer.from_file(paths[0])
    text = f"x{run * 1_000_000}a b"
    assert list(packing.encoder(*paths)(text)) == slow.encode(text, add_special_tokens=False).ids


def test_ten_million_blanks(spark):
    text = " " * 10_000_000 + "a"
    rows = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in rows) == 10_000_001  # a blank each but the last, which goes with the letter, and the end


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t", "\u2003", "\x1c", "\x85", "a", "9", "é", "\U0001f642"]), st.sampled_from([1, 2, 3, 9_999, 10_000, 10_001])), max_size=5))
def test_any_text_has_the_tokenizers_ids(parts):
    paths, text = packing.vocabulary(), "".join(c * n for c, n in parts)
    assert list(packing.encoder(*paths)(text)) == Tokenizer.from_file(paths[0]).encode(text, add_special_tokens=False).ids


def test_edges(edges, none):
    check(packing.pack(edges).collect(), [(r["doc_id"], r["text"]) for r in edges.collect()])
    assert packing.pack(none).count() == 0


def test_documents_are_packed_tightly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    sequences = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sequences <= 1.02 * sum(r["length"] for r in rows) / packing.SEQUENCE + 2
