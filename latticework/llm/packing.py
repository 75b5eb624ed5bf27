"""Best-fit packing of tokenised documents (operator 4).

A document's ids are those of the byte-level BPE vocabulary plus an end id.  Only
documents longer than a sequence are cut: the remainder comes first, then whole
sequences.  Pieces are packed by bounded-space online best fit: at most ``OPEN``
bins are open; the free space of each open bin is a bit of an integer, so the
tightest bin that holds a piece is the lowest set bit at or above its length; when
one bin too many is open, the fullest closes.  The packer sees one piece at a time.
In which order they arrive is free: they are dealt to runs of about ``RUN`` pieces by
hash, and each run comes with the longest first, which leaves 0.1 % of the space free
instead of 1 %.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, picked, raw_texts, slices

SEQUENCE, END_ID, OPEN = 1024, 2, 1024
RUN = 1024  # pieces that arrive the longest first
PIECES_A_TASK = 100_000  # one task's open bins are a small share of so many pieces
_SPECIAL = "<|endoftext|>"
_BLANKS = re.compile(r"(?<!\s)\s{10000}")  # the fast encoder gives up on far longer runs of white space
_PROBE = "The ’quick’ brown-fox's 123 jumped.\n\n  Ça и 漢字 🙂\t--x  "


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Paths of the vocabulary for the two tokenizer libraries, and the pattern that splits words."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


@cache
def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from a text to its ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The same vocabulary as ranks is several times faster.  It is used after a probe
    text agreed, for texts without the special token's string and without long runs
    of white space; the tokenizer file itself encodes the others, of any length.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    exact = lambda text: slow.encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return exact
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if fast.encode_ordinary(_PROBE) != exact(_PROBE):
        return exact
    hard = lambda text: _SPECIAL in text or (len(text) >= 10_000 and _BLANKS.search(text) is not None)
    return lambda text: exact(text) if hard(text) else fast.encode_ordinary(text)


def cuts(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be short."""
    first = n % most or min(n, most)
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(paths: tuple[str, str | None, str | None], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                ids = np.array([*encode((raw or b"").decode("utf-8", "replace")), END_ID], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), most)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), row), strict=True):
                        column.append(value)
                    row += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [*_PIECE, "row"])

    return run


def best_fit(lengths: Iterable[int], capacity: int = SEQUENCE, open_bins: int = OPEN) -> Iterator[tuple[int, int]]:
    """The (bin, offset) of each length, in order; lengths are 1 to ``capacity``."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits = count = bins = 0
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_free[free].pop()
            count -= 1
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            free, bin_ = capacity, bins
            bins += 1
        yield bin_, capacity - free
        free -= length
        if free:
            by_free[free].append(bin_)
            free_bits |= 1 << free
            count += 1
            if count > open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                count -= 1
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        waiting: list[int] = []

        def feed() -> Iterator[int]:
            while True:
                yield waiting.pop()

        fitted = best_fit(feed(), capacity)
        for batch in batches:
            bins, offsets = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for at, length in enumerate(batch.column("length").to_pylist()):
                waiting.append(length)
                bins[at], offsets[at] = next(fitted)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE), pa.array(bins + place), pa.array(offsets)], [*_PIECE, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SEQUENCE, paths: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id.  Rows with equal doc_ids are
    packed each on its own; a null doc_id stays null.  Texts are tokenised once;
    only the pieces' numbers are dealt out, about ``PIECES_A_TASK`` to a task, by hash
    of the piece's row, so neither a hot key nor repeated rows matter and a lost task
    is packed again alike.  Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    own = picked(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    pieces = scratch.table(own.mapInArrow(_pieces(paths or vocabulary(), most), f"{_PIECE_SCHEMA}, row long"))
    count = pieces.count()
    runs = F.pmod(F.xxhash64("row"), F.lit(max(1, count // RUN)))
    dealt = pieces.withColumn("run", runs).repartition(max(1, -(-count // PIECES_A_TASK)), "run").sortWithinPartitions("run", F.desc("length"), "row")
    return dealt.mapInArrow(_packed(most), f"{_PIECE_SCHEMA}, sequence_id long, offset long")
