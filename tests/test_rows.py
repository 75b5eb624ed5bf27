"""How much of a row-at-a-time transform is held at once."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest

from latticework.functions import rows
from latticework.queries import _word_rows


class Handed:
    """Stands for a frame: keeps the function that its batches would go through."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_few_rows_are_held_whatever_a_batch_yields(spark):
    run = rows.emit_rows(Handed(), lambda r: ({"w": r["t"], "n": i} for i in range(r["n"])), "w string, n long")
    batch = pa.RecordBatch.from_pylist([{"t": "x", "n": 50_000}, {"t": "y", "n": 0}, {"t": None, "n": 0}, *({"t": "z", "n": 500} for _ in range(300))])
    tracemalloc.start()
    sizes, last = [], None
    for out in run(iter([batch, batch])):
        sizes.append(out.num_rows)
        last = out.column("n")[-1].as_py()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * (50_000 + 150_000) and max(sizes) == rows.ROWS and last == 499
    assert most < 4e6  # 200,000 rows at once take over 40 MB
    assert [b.num_rows for b in run(iter([batch.slice(1, 2)]))] == []


def test_output_batches_are_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(rows, "CHARS", 1_000)
    run = rows.emit_rows(Handed(), lambda r: ({"w": r["t"]} if i else {} for i in range(6)), "w string, n long")
    got = list(run(iter([pa.RecordBatch.from_pylist([{"t": "x" * 600}])])))
    assert [b.num_rows for b in got] == [3, 2, 1] and [b.column("w").null_count for b in got] == [1, 0, 0]


@pytest.mark.parametrize("text", [None, "", "short", "sevenly", "a  longest\nwordhere \n end", "tab\tis\rno\x0bmark", "é漢字🙂 漢字漢字漢字漢 ", "x" * 9_999])
def test_long_words_are_those_between_blanks_and_line_feeds(text):
    want = [len(w) for line in (text or "").split("\n") for w in line.split(" ") if len(w) > 6]
    assert [r["letters"] for r in _word_rows({"lang": "en", "text": text})] == want
