"""Readers by file type, each giving a DataFrame of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from latticework.plans.spec import InputSpec, SpecError


class UnsupportedSource(RuntimeError):
    """The session lacks the module that reads a format."""


def read_text(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row a line, in ``value``."""
    return spark.read.text(list(paths))


def read_json(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; a malformed line fails the read. Without a schema one is inferred by a pass over the data."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(list(paths))


def read_parquet(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """Columns that a given schema has and a file lacks are NULL."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_orc(spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).orc(list(paths))


def read_avro(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records; files of key-value pairs have the columns ``key`` and ``value``. Needs Spark's avro module."""
    try:
        return spark.read.format("avro").load(list(paths))
    except Exception as e:
        if "avro" in str(e).lower() and ("Failed to find" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e) or "AVRO" in str(e)):
            raise UnsupportedSource("reading avro needs the spark-avro package on the classpath") from e
        raise


def read_sequence(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The values of sequence files as text in ``value``: no DataFrame source reads them."""
    rows = spark.sparkContext.sequenceFile(",".join(paths)).map(lambda kv: (kv[1].decode("utf-8", "replace") if isinstance(kv[1], (bytes, bytearray)) else None if kv[1] is None else str(kv[1]),))
    return spark.createDataFrame(rows, StructType([StructField("value", StringType())]))


def nested_columns(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Only these fields, dotted where nested; siblings of one record stay one struct, so the scan reads just these."""
    tree: dict = {}
    for f in fields:
        at = tree
        for part in f.split("."):
            at = at.setdefault(part, {})

    def build(prefix: str, under: dict):
        return F.col(prefix) if not under else F.when(F.col(prefix).isNotNull(), F.struct(*(build(f"{prefix}.{n}", u).alias(n) for n, u in under.items())))

    return df.select(*(build(n, u).alias(n) for n, u in tree.items()))


def read(spark: SparkSession, spec: InputSpec, paths: Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """All paths of an input as one frame (a union of all rows), with only the fields it names if it names any."""
    kind = spec.file_type
    if kind == "text":
        df = read_json(spark, paths, schema) if spec.data_type == "json" else read_text(spark, paths)
    elif kind == "parquet":
        df = read_parquet(spark, paths, schema)
    elif kind == "orc":
        df = read_orc(spark, paths, schema)
    elif kind == "avro":
        df = read_avro(spark, paths)
    elif kind == "sequence":
        df = read_sequence(spark, paths)
    else:
        raise SpecError(f"unknown file type {kind!r}")
    return nested_columns(df, spec.fields) if spec.fields else df


def with_file(df: DataFrame) -> DataFrame:
    """Adds ``file_path`` and ``file_name`` of each record's file."""
    return df.withColumn("file_path", F.col("_metadata.file_path")).withColumn("file_name", F.col("_metadata.file_name"))
