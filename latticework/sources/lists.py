"""Configured lists for filters: from a database or from text files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.jdbc import read_rows
from latticework.plans.spec import ConfigSource, SpecError
from latticework.sources.paths import fill

SHORT = 10_000  # lines; a longer list stays a table and is joined


def _jdbc(spark: SparkSession, source: ConfigSource, start: datetime) -> DataFrame:
    options = dict(source.params)
    url = options.pop("url", None) or f"jdbc:mysql://{options.pop('ip', 'localhost')}:{options.pop('port', '3306')}/{options.pop('dbName', '')}"
    options = {{"passwd": "password"}.get(k, k): v for k, v in options.items()}
    rows = read_rows(spark, url, fill(source.sql or "", start), options)
    return rows.select(F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("value"))


def config_table(spark: SparkSession, source: ConfigSource, start: datetime, base_dir: str | None = None) -> DataFrame:
    """The list as a table with one text column; the columns of a database row are joined by tabs."""
    if source.type.upper() == "DB":
        return _jdbc(spark, source, start)
    if source.type.upper() == "HDFS":
        path = fill(source.path or "", start)
        if base_dir and "://" not in path and not path.startswith("/"):
            path = f"{base_dir.rstrip('/')}/{path}"
        return spark.read.text(path).where(F.length("value") > 0)
    raise SpecError(f"config {source.id!r}: unknown type {source.type!r}")


def load_lists(spark: SparkSession, sources: tuple[ConfigSource, ...], start: datetime, base_dir: str | None = None, short: int = SHORT) -> dict[str, list[str] | DataFrame]:
    """Each list by id: a Python list up to ``short`` lines, else the table. An empty one is an empty list."""
    out: dict[str, list[str] | DataFrame] = {}
    for s in sources:
        table = config_table(spark, s, start, base_dir)
        head = [r["value"] for r in table.take(short + 1)]
        out[s.id] = head if len(head) <= short else table
    return out
