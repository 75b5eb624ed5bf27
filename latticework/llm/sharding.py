"""Sharding by a consistent-hash ring with bounded loads (operator 9).

The ring has 2**15 slices; a key's slice is the top of its hash.  Each shard owns
``VIRTUAL`` points of the ring, drawn from its number, and a slice goes to the next
point clockwise.  Shards are bounded: n rows over k shards leave each a load of
floor(n / k), and one more for the first n mod k, so counts differ by one at most.
Keys that find their shard full continue clockwise to the next shard with room.

The walk needs the slices' counts alone (2**15 at most, whatever the input): it
assigns runs of ranks in a slice to shards.  A row's rank in its slice then gives
its shard and its slot.  Ranks come from one sort by ranges that divides equal keys,
so a key with a third of all rows lies in many tasks.  With another number of shards the points of the old ones
stay, so a row moves only if a new point precedes its old one or a bound pushed it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, picked, with_place

SHARDS, VIRTUAL, SLICE_BITS = 16, 128, 15
SLICES = 1 << SLICE_BITS


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """The points (position, shard), clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big")
    return sorted((at(s, v) * SLICES >> 64, s) for s in range(shards) for v in range(virtual))


def bounds(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int]]:
    """Runs (slice, first rank, end rank, shard, first slot) for the slices' counts."""
    points = ring(shards, virtual)
    room, used = bounds(sum(counts.values()), shards), [0] * shards
    places = [p for p, _ in points]
    following = list(range(len(points)))  # the next point whose shard may have room
    runs = []

    def open_point(i: int) -> int:
        path = []
        while used[points[i][1]] == room[points[i][1]]:
            path.append(i)
            i = following[i] if following[i] != i else (i + 1) % len(points)
        for p in path:
            following[p] = i
        return i

    for piece in sorted(counts):
        first, left = 0, counts[piece]
        i = bisect_left(places, piece) % len(points)
        while left:
            i = open_point(i)
            shard = points[i][1]
            take = min(left, room[shard] - used[shard])
            runs.append((piece, first, first + take, shard, used[shard]))
            used[shard] += take
            first, left = first + take, left - take
    return runs


def slice_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(9), key), 64 - SLICE_BITS).cast("int")


def assign(rows: DataFrame, key: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """``rows`` with their shard and slot (gapless from 0 in each shard).

    ``order`` tells the rows of a slice apart; equal rows may swap their slots.
    """
    scratch = Scratch(rows.sparkSession, "sharding")
    # written, so that each row keeps its number, which alone tells equal rows apart
    cut = scratch.table(rows.withColumns({"_slice": slice_of(F.col(key)), "_row": F.monotonically_increasing_id()}))
    counts = {r["_slice"]: r["count"] for r in cut.groupBy("_slice").count().collect()}  # at most 2**15
    before = dict(zip(sorted(counts), accumulate((counts[s] for s in sorted(counts)), initial=0), strict=False))
    runs = [(s, before[s] + first, before[s] + end, shard, slot) for s, first, end, shard, slot in walk(counts, shards)]
    runs = rows.sparkSession.createDataFrame(runs, "_slice int, _first long, _end long, shard int, _slot long")
    placed = with_place(cut, scratch, [F.col("_slice"), F.xxhash64(F.lit(9), F.col(key)), *map(F.col, order), F.col("_row")], "_place")
    # at most 2**15 runs and one for each shard that fills up
    out = placed.join(F.broadcast(runs), "_slice").where("_place >= _first and _place < _end")
    return out.withColumn("slot", F.col("_slot") + F.col("_place") - F.col("_first")).drop("_slice", "_row", "_place", "_first", "_end", "_slot")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law that holds is ``rows``.  A null text has size 1 and the checksum 0 of
    an empty one; rows with equal or null doc_ids are keys in one slice, which the
    bounds split over shards like any other.  Other columns are ignored.
    """
    words = F.coalesce(F.col("text"), F.lit(""))
    rows = picked(docs, doc_id=(doc_id, "long"), text=(text, "string")).select("doc_id", (F.octet_length(words) + 1).cast("long").alias("size"), F.crc32(words.cast("binary")).alias("text_crc32"))
    out = assign(rows, "doc_id", ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
