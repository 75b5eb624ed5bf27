"""Nearest neighbours by a block matrix join (operator 5).

Vectors are packed into blocks: up to ``QUERY_BLOCK`` queries or ``BLOCK``
candidates a row, as float matrices beside their int8 forms.  Each block of
candidates meets each block of queries once.  The product of two int8 tiles gives
the distances of the quantised vectors; with the residual norms these bound the
true distances from below and above.  A pair survives if its lower bound is no
larger than the k-th smallest upper bound of its query in the tile, nor than the k-th
distance that its query has met in the task; survivors are computed again from the
original vectors in double precision and merged by heaps in the task.  The vectors
travel in their own precision, so that copies of a vector by the thousand, or vectors
closer than quantisation tells apart, never leave the tile as pairs.  One window over the queries merges what the tasks found.  The result is
exact: no index, no candidate is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import Scratch, picked, shuffle_partitions

QUERY_BLOCK, BLOCK, NEAREST, QUERY_STEP = 1024, 4096, 10, 100
_EXACT_COLUMNS = 1024  # 127 * 127 * 1024 < 2**24: a float32 product of int8 tiles this wide is exact


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the norms of what quantisation leaves."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True) / 127, np.finfo(np.float64).smallest_subnormal)
    q = np.rint(x / scale).clip(-127, 127).astype(np.int8)
    with np.errstate(over="ignore"):
        return q, scale[:, 0], np.sqrt(((x - q * scale) ** 2).sum(axis=1))


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int8 product of two tiles, exact."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT_COLUMNS):
        out += a[:, at : at + _EXACT_COLUMNS].astype(np.float32) @ b[:, at : at + _EXACT_COLUMNS].astype(np.float32).T
    return out


def survivors(qa: tuple, qb: tuple, own: np.ndarray, k: int, met: np.ndarray | None = None) -> np.ndarray:
    """True for the pairs that may be among a query's k nearest; ``own`` marks pairs that take no part,
    ``met`` is each query's k-th distance so far.  A bound that overflows lets its pair survive."""
    (a, sa, ea), (b, sb, eb) = qa, qb
    with np.errstate(over="ignore", invalid="ignore"):
        norm_a, norm_b = (((q.astype(np.float64) ** 2).sum(axis=1)) * s * s for q, s in ((a, sa), (b, sb)))
        size = norm_a[:, None] + norm_b[None, :]
        squared = size - 2 * sa[:, None] * sb[None, :] * tile_product(a, b)
        spare = size * 1e-12
        near = np.sqrt(np.maximum(squared - spare, 0)) - ea[:, None] - eb[None, :]
        far = np.sqrt(np.maximum(squared, 0) + spare) + ea[:, None] + eb[None, :]
        far[own | np.isnan(far)] = np.inf
        limit = np.partition(far, min(k, far.shape[1]) - 1, axis=1)[:, min(k, far.shape[1]) - 1]
        if met is not None:
            limit = np.minimum(limit, met)
        return ~(near > (limit * (1 + 1e-9))[:, None]) & ~own


_BLOCK_SCHEMA = "dim int, ids binary, vectors binary"


def _blocks(most: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dim: int, some: list) -> pa.RecordBatch:
            ids, rows = zip(*some, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.stack(rows).tobytes()])], ["dim", "ids", "vectors"])

        for batch in batches:
            vectors = batch.column("vector")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                vector = flat[offsets[i] : offsets[i + 1]].astype(kind)
                some = held.setdefault(len(vector), [])
                some.append((vec_id, vector))
                if len(some) == most:
                    yield row(len(vector), held.pop(len(vector)))
        for dim, some in held.items():
            yield row(dim, some)

    return run


def _matrix(ids: bytes, vectors: bytes, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)


def _join(k: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        seen: tuple | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if seen is None or seen[0] != (row["dim"], row["block"]):
                    ids, x = _matrix(row["query_ids"], row["query_vectors"], row["dim"], kind)
                    seen = (row["dim"], row["block"]), ids, x, quantise(x), np.full(len(ids), np.inf)
                (_, block), query_ids, queries, quantised, met = seen
                ids, x = _matrix(row["ids"], row["vectors"], row["dim"], kind)
                keep = survivors(quantised, quantise(x), query_ids[:, None] == ids[None, :], k, met)
                for i in np.flatnonzero(keep.any(axis=1)):
                    some = np.flatnonzero(keep[i])
                    with np.errstate(over="ignore"):
                        exact = np.sqrt(np.cumsum((x[some] - queries[i]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
                    best = np.lexsort((ids[some], exact))[:k]
                    found = list(zip(exact[best].tolist(), ids[some][best].tolist(), strict=True))
                    old = heaps.get(key := (int(query_ids[i]), block))
                    heaps[key] = found if old is None else heapq.nsmallest(k, heapq.merge(old, found))
                    if len(heaps[key]) == k:
                        met[i] = heaps[key][-1][0]
        rows = [(query, score, vec) for (query, _), best in heaps.items() for score, vec in best]
        for at in range(0, len(rows), 50_000):
            columns = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "score", "vec_id"])

    return run


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, step: int = QUERY_STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows, its own id left out.

    Queries are the rows whose id is divisible by ``step``.  Rows with a null id,
    or a vector that is null, empty, zero, or holds null or non-finite components
    take no part; vectors meet those of their own length only.  Equal distances go
    by vec_id; repeated rows are candidates each, but a query id repeated has one
    answer, for its least vector.  A distance beyond a double's range is infinite.
    A query without any candidate has no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    given = picked(vectors, vec_id=(vec_id, "long"), vector=(vector, None))
    x = F.col("vector")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    sound = given.where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id", x)
    kind = np.float32 if dict(sound.dtypes)["vector"] == "array<float>" else np.float64
    sound = sound if kind is np.float32 else sound.withColumn("vector", x.cast("array<double>"))
    # a block of a few thousand vectors a row: the tables below have few, large rows
    candidates = scratch.table(sound.mapInArrow(_blocks(BLOCK, kind), _BLOCK_SCHEMA))
    asked = sound.where(F.pmod("vec_id", F.lit(step)) == 0)
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.repartition(parts, "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).mapInArrow(_blocks(QUERY_BLOCK, kind), _BLOCK_SCHEMA)
    queries = scratch.table(queries.select("dim", F.xxhash64("ids").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")))
    # every block of candidates for every block of queries of its dimension, on an equal key
    names = queries.groupBy("dim").agg(F.collect_set("block").alias("blocks"))  # one number for each thousand queries
    dealt = candidates.join(names, "dim").withColumn("block", F.explode("blocks")).drop("blocks")
    tiles = dealt.join(queries, ["dim", "block"]).repartition(shuffle_partitions(spark), F.xxhash64("block", "ids")).sortWithinPartitions("dim", "block")
    found = tiles.mapInArrow(_join(k, kind), "query_id long, score double, vec_id long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
