"""What the operators share: tables in the cluster's shared folder, places and
components over data of any size, and slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.scratch import shared_folder


_opened: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)


@contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes, at its end, the tables of every ``Scratch`` made within the block: what was returned must be written by then."""
    token = _opened.set([])
    try:
        yield
    finally:
        made = _opened.get()
        _opened.reset(token)
        for scratch in made:
            scratch.drop_all()


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors.

    ``table`` writes a frame and returns it as read back; ``drop`` deletes tables
    that no later frame reads.  The frame an operator returns reads the rest.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        if (opened := _opened.get()) is not None:
            opened.append(self)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def table(self, frame: DataFrame) -> DataFrame:
        path = self.path()
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame.scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(frame: DataFrame) -> DataFrame:
    """``frame`` with its columns called c0, c1, ...: whatever they are called, also alike or alike but for case, none clashes
    with another or with one that an operator adds.  ``toDF(*frame.columns)`` gives the names back."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def number_of(frame: DataFrame, name: str) -> str:
    """What ``numbered`` calls the column of this exact name; failing that, the one that differs in case alone."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        if hits := [i for i, c in enumerate(frame.columns) if same(c)]:
            return f"c{hits[0]}"
    raise ValueError(f"no column {name!r} among {frame.columns}")


def picked(frame: DataFrame, **wanted: tuple[str, str | None]) -> DataFrame:
    """The columns ``new name = (name, type or None to keep it)`` of a frame, and no others."""
    columns = [F.col(number_of(frame, name)) for name, _ in wanted.values()]
    return numbered(frame).select(*((c.cast(kind) if kind else c).alias(new) for c, (new, (_, kind)) in zip(columns, wanted.items(), strict=True)))


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows with a bounded size of ``column``, so
    that the Python copies of a batch with long texts stay small."""
    for batch in batches:
        at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < batch.num_rows:
            end, size = at, 0
            while end < batch.num_rows and (end == at or size + sizes[end] <= most_bytes) and end - at < most_rows:
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def _stars_done(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


HOT = 1000  # keys with more than this part of all rows are hot: there are fewer than so many


def join_counted(rows: DataFrame, counts: DataFrame, key: str, count: str, scratch: Scratch) -> DataFrame:
    """``rows`` joined with ``counts``, which has one row for each key and, in ``count``, how many rows have it.

    The rows of hot keys, fewer than ``HOT`` by their definition, are joined where they
    lie, so a key with a third of all rows never meets in one task; the others by key.
    """
    counts = scratch.table(counts)
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = counts.where(F.col(count) > total / HOT)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counts.where(F.col(count) <= total / HOT), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


SALTS = 8  # tasks that share the edges of one hub


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """``edges`` with ``m``, the least neighbour of ``node`` among those below it, NULL if it has none.

    A hub's edges are dealt to ``SALTS`` tasks by their other end, and its one row to each of them.
    Where Spark finds the rows few enough to broadcast, what it sends is ``SALTS`` times the size it
    checked at most.
    """
    least = edges.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("m")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    return salted.join(least, (F.col(node) == F.col("_node")) & (salted["_salt"] == least["_salt"]), "left").select("a", "b", "m")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for each node of ``edges (a, b)``; a component's name is its smallest node.

    Alternating large and small stars: each round hangs every node's larger
    neighbours, then its smaller ones, on its least neighbour.  Each round is two
    aggregations with map-side combining and two salted equi-joins, written to the
    shared folder; nothing but a count and a checksum reaches the driver.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _stars_done(now)
    while seen[0]:
        # the larger neighbours of each node hang on its least neighbour, or on it
        large = scratch.table(_with_least(now, "b", "a").select("a", F.coalesce("m", "b").alias("b")).distinct())
        hung = _with_least(large, "a", "b")
        after = scratch.table(hung.select("a", F.col("m").alias("b")).union(hung.where("b <> m").select("b", "m")).distinct())
        scratch.drop(now, large)
        now, before, seen = after, seen, _stars_done(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def with_place(frame: DataFrame, scratch: Scratch, order: list[Column], name: str = "place") -> DataFrame:
    """``frame`` with each row's place, from 0, among all rows in ``order``.

    The rows are dealt out by ranges of the order, numbered within them and
    written; the ranges' counts, one row each, give every range its first place.
    So no task holds more than a range.  ``order`` must tell rows apart where
    ranges are to stay even.
    """
    spark = frame.sparkSession
    cut = frame.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # an id is the number of its partition, then of its row there
    cut = scratch.table(cut.withColumn("_at", F.monotonically_increasing_id()))
    range_of, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = cut.groupBy(range_of.alias("_range")).count().collect()  # one row a shuffle partition
    starts, at = [], 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        starts.append((r["_range"], at))
        at += r["count"]
    start = spark.createDataFrame(starts, "_range long, _start long")
    out = cut.withColumn("_range", range_of).join(F.broadcast(start), "_range")  # as many rows
    return out.withColumn(name, F.col("_start") + row).drop("_range", "_start", "_at")
