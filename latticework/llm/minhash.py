"""Near-duplicates of whole texts by HyperMinHash (operator 1).

1. Each text's set of five-word shingles is hashed once; the first seven bits of
   a hash choose one of 128 buckets, whose least remainder is kept compressed:
   its count of leading zeros and ten bits after the leading one (16 bits).
2. Texts with equal sets form a class by the set's 128-bit digest; the class's
   smallest doc_id stands for it.
3. Bands of four registers are keyed, and so is each set of three shingles and each
   three of a set of four; a key that two or more classes share is a group.  Groups
   with equal members are one group.
4. Each group is compared in tiles of at most ``2 * BLOCK`` sketches: the share of
   equal registers, corrected for registers that agree by chance, estimates the
   Jaccard similarity.  A tile returns a forest of pairs whose estimate reaches
   the threshold less 4.5 standard errors, so never a row for every pair.
5. The components of these forests are clusters.  Each is compared in tiles once
   more, now on full sets: the exact count of shared shingles decides, and a tile
   returns a forest of the exact links.  Their components are the result.

A pair of similarity J shares no band with probability (1 - J**4)**32: 5e-6 at
0.75.  Small sets would miss less often, but for three shingles and four of which
three are shared: the fourth lies in the one band of the three with 3e-5.  These
have the keys of threes, so none is missed.  A pair in one cluster is compared
whether or not it shares a band.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, connected_components, join_counted, number_of, numbered, picked, raw_texts, shuffle_partitions, slices
from latticework.llm.shingles import mix, shingle_sets

BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
SHARE, OF = 75, 100  # linked if OF * shared >= SHARE * united
BLOCK, BLOCK_BYTES = 512, 16 << 20
ERRORS = 4.5
_FIRST = np.arange(BUCKETS, dtype=np.uint64)
_BOUNDS = _FIRST << np.uint64(64 - BUCKET_BITS)
_LEVELS = 64 - BUCKET_BITS


def registers(found: np.ndarray) -> np.ndarray:
    """The 128 compressed registers of a sorted set; 0 marks an empty bucket."""
    if not len(found):
        return np.zeros(BUCKETS, np.uint16)
    at = np.minimum(np.searchsorted(found, _BOUNDS), len(found) - 1)
    least = found[at]
    full = (least >> np.uint64(64 - BUCKET_BITS)) == _FIRST
    rest = (least << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits, so exact as a float
    part, exponent = np.frexp(rest.astype(np.float64))
    mantissa = np.floor((np.maximum(part, 0.5) * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    zeros = 53 - exponent
    return np.where(full, ((zeros + 1) << MANTISSA_BITS) | mantissa, 0).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band that has a full bucket."""
    bands = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = bands[:, 0] | bands[:, 1] << np.uint64(16) | bands[:, 2] << np.uint64(32) | bands[:, 3] << np.uint64(48)
    return mix(mix(key) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[key != 0]


def three_keys(found: np.ndarray) -> list[int]:
    """A 64-bit key for each three shingles of a sorted set of three or four; none for others."""
    threes = combinations(found.tolist(), 3) if 3 <= len(found) <= 4 else ()
    return [int.from_bytes(hashlib.blake2b(np.array(t, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True) for t in threes]


@cache
def _chance() -> np.ndarray:
    """The probability that two registers agree though their minima differ, by the
    whole binary logarithms of the two sets' sizes."""
    cells = []
    steps = np.arange((1 << MANTISSA_BITS) + 1) / (1 << MANTISSA_BITS) + 1
    for log in range(33):
        each = 2.0 ** (log + 0.5) / BUCKETS
        p = [-np.diff(np.exp(-each * 2.0 ** -(z + 1) * steps)) for z in range(_LEVELS)]
        p = np.concatenate(p)
        cells.append(p / p.sum())
    cells = np.array(cells)
    return cells @ cells.T


def estimates(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarities of sketches, row by row, and the buckets they rest on."""
    same = ((a == b) & (a != 0)).sum(axis=-1)
    used = np.maximum(((a != 0) | (b != 0)).sum(axis=-1), 1)
    chance = _chance()[np.log2(np.maximum(sizes_a, 1)).astype(int), np.log2(np.maximum(sizes_b, 1)).astype(int)]
    return (same / used - chance) / (1 - chance), used


def likely(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """True unless the estimate lies ``ERRORS`` standard errors under the threshold, or the sizes forbid a link."""
    found, used = estimates(a, b, sizes_a, sizes_b)
    least = SHARE / OF
    near = found >= least - ERRORS * np.sqrt(least * (1 - least) / used) - 1 / used
    return near & (OF * np.minimum(sizes_a, sizes_b) >= SHARE * np.maximum(sizes_a, sizes_b))


def _forest(n: int, joined) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``joined(i, rest)`` tells which of ``rest`` are linked to ``i``."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = joined(i, rest)
            edges += [(i, int(j)) for j in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def sketch_forest(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    edges = _forest(len(nodes), lambda i, rest: likely(sketches[i], sketches[rest], sizes[i : i + 1], sizes[rest]))
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def exact_forest(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    def joined(i: int, rest: np.ndarray) -> np.ndarray:
        hit = likely(sketches[i], sketches[rest], sizes[i : i + 1], sizes[rest])
        maybe = rest[hit]
        if len(maybe):
            other = np.concatenate([sets[j] for j in maybe])
            at = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
            shared = np.add.reduceat(sets[i][at] == other, np.cumsum([0, *sizes[maybe][:-1]]), dtype=np.int64)
            hit[hit] = OF * shared >= SHARE * (sizes[i] + sizes[maybe] - shared)
        return hit

    return [(int(nodes[i]), int(nodes[j])) for i, j in _forest(len(nodes), joined)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, digests, sketches, threes = [], [], [], []
        for found in shingle_sets(raw_texts(batch.column("text"))):
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            sketches.append(registers(found).tobytes())
            threes.append(three_keys(found) or None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(threes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch", "threes"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [band_keys(np.frombuffer(s, np.uint16)).view(np.int64) for s in batch.column("sketch").to_pylist()]
        keys = [np.append(k, np.array(t, np.int64)) if t else k for k, t in zip(keys, batch.column("threes").to_pylist(), strict=True)]
        counts = [len(k) for k in keys]
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), counts))], ["band", "node"])


def _tiles(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The whole runs of rows with equal ``key`` in batches sorted by it, small runs together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in key:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        first = batch.slice(0, 1)
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != first.column(k)[0] for k in key):
            yield pa.Table.from_batches(held)
            held = []
        last = np.flatnonzero(change)
        if len(last):
            cut = int(last[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_TILE = ["gid", "i", "j"]


def _compare(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _tiles(batches, _TILE):
            keys = np.stack([part.column(k).to_numpy() for k in _TILE])
            cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [part.num_rows]))
            nodes, sizes = part.column("node").to_numpy(), part.column("n_shingles").to_numpy()
            sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            raw = part.column("found").to_pylist() if exact else []
            edges: list[tuple[int, int]] = []
            two = cut[:-1][np.diff(cut) == 2]
            if not exact and len(two):
                hit = two[likely(sketches[two], sketches[two + 1], sizes[two], sizes[two + 1])]
                edges += zip(nodes[hit].tolist(), nodes[hit + 1].tolist(), strict=True)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if exact:
                    edges += exact_forest(nodes[a:b], sizes[a:b], sketches[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]])
                elif b - a > 2:
                    edges += sketch_forest(nodes[a:b], sizes[a:b], sketches[a:b])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = list(shingle_sets(raw_texts(batch.column("text"))))
        keep = [batch.column(n) for n in ("node", "gid", "blocks")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "gid", "blocks", "n_shingles", "sketch", "found"])


def _tile_rows(frame: DataFrame) -> DataFrame:
    """Each member of a group once for every tile it is in: a group of ``blocks`` blocks has a tile for each pair of blocks."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    out = frame.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    out = out.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
    # with more than one block the tile (i, i) lies within (i, j)
    out = out.where("blocks = 1 or i <> j").drop("_own", "_other", "blocks")
    return out.repartition(shuffle_partitions(frame.sparkSession), *_TILE).sortWithinPartitions(*_TILE)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, class_id.

    component_id is the smallest doc_id reachable over links, itself included;
    class_id the smallest doc_id with the same shingle set.  A null or wordless
    text has an empty set and is linked with nothing.  Rows with one doc_id are
    one document in the links; a row whose doc_id is null is linked with nothing,
    has a null component and isn't kept.  Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    own = picked(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    base = scratch.table(own.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, sketch binary, threes array<long>"))
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(full.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    # a class's row is the one whose doc_id is the class's
    sketches = full.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"])
    sketches = scratch.table(sketches.select(F.col("doc_id").alias("node"), "n_shingles", "sketch", "threes"))
    bands = scratch.table(sketches.select("node", "sketch", "threes").mapInArrow(_bands, "band long, node long"))
    groups = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("members > 1")
    groups = groups.select("band", "members", F.xxhash64("members", "sum").alias("gid"), F.ceil(F.col("members") / BLOCK).alias("blocks"))
    members = join_counted(bands, groups, "band", "members", scratch).select("gid", "blocks", "node").distinct()
    near = _tile_rows(members.join(sketches.drop("threes"), "node")).mapInArrow(_compare(False), "a long, b long")
    clusters = scratch.table(connected_components(near, scratch).select("node", F.col("component").alias("gid")))
    scratch.drop(bands)
    weights = clusters.join(sketches.select("node", "n_shingles"), "node").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_shingles") * 8).alias("bytes"))
    weights = weights.select("gid", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    texts = own.withColumnRenamed("doc_id", "node").join(join_counted(clusters, weights, "gid", "n", scratch).drop("n"), "node")
    sets = texts.mapInArrow(_full_sets, "node long, gid long, blocks long, n_shingles long, sketch binary, found binary")
    links = _tile_rows(sets).mapInArrow(_compare(True), "a long, b long")
    components = connected_components(links, scratch)
    scratch.drop(sketches, clusters)
    out = base.drop("sketch", "threes").join(classes, "digest", "left").join(components, F.col("class_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of others, with all their columns.

    Of each component the document with the smallest doc_id stays.  Where rows share
    a doc_id, each of its different texts is a document of its own, so one goes only
    if it is linked with another that stays, of two with one doc_id the larger text;
    of rows with one doc_id and text, also a null one, the one with the smallest other
    columns, written as JSON, stays.  Rows with a null doc_id all do.  Columns may have any names.
    """
    plain, key, words = numbered(docs), F.col(number_of(docs, doc_id)).cast("long"), F.col(number_of(docs, text)).cast("string")
    repeated = plain.where(key.isNotNull()).groupBy(key).count().where("count > 1").limit(1).count()
    if not repeated:
        found = near_duplicates(docs, doc_id, text)
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
        return plain.join(gone, key == F.col("gone"), "left_anti").toDF(*docs.columns)
    scratch = Scratch(docs.sparkSession, "repeated-documents")
    # written, so that each row keeps its number
    rows = scratch.table(plain.where(key.isNotNull()).withColumns({"key": key, "words": words, "row": F.monotonically_increasing_id()}))
    # any column can be written as text, also one that has no order
    others = F.to_json(F.struct(*(c for c in plain.columns if c != number_of(docs, text))))
    each = rows.groupBy("key", "words").agg(F.min(F.struct(others.alias("others"), "row"))["row"].alias("id"))
    each = scratch.table(each)
    found = near_duplicates(each, "id", "words").select(F.col("doc_id").alias("id"), "component_id")
    first = found.join(each, "id").groupBy("component_id").agg(F.min(F.struct("key", "words", "id"))["id"].alias("kept"))
    out = rows.join(first.select("kept"), F.col("row") == F.col("kept"), "left_semi").select(*plain.columns)
    return out.unionByName(plain.where(key.isNull())).toDF(*docs.columns)
