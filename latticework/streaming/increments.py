"""A report's finest period states from a stream.

Each micro-batch is reduced to its cube's states, keyed by period, and stored
under its batch id, so a batch that is run again replaces itself (exactly once).
Reading merges the batches' states of a period: late rows need no watermark, they
are one more state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.operators.cube import States, merged, report_states
from latticework.plans.frequency import Frequency
from latticework.plans.spec import ReportSpec

_GRAINS = {Frequency.Hourly: "hour", Frequency.Daily: "day", Frequency.Weekly: "week", Frequency.Monthly: "month", Frequency.Quarterly: "quarter", Frequency.Yearly: "year"}


def period_start(ts: Column, freq: Frequency) -> Column:
    """The calendar period a moment lies in."""
    if freq not in _GRAINS:
        raise ValueError(f"{freq.value} periods have no fixed calendar start")
    return F.date_trunc(_GRAINS[freq], ts).cast("timestamp")


def start_stream(records: DataFrame, spec: ReportSpec, ts: Column, root: str, checkpoint: str, trigger: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts the query that stores each batch's states under ``root``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = (prepare(df) if prepare else df).withColumn("period_start", period_start(ts, spec.min_freq))
        states = report_states(rows, spec, extra=["period_start"])
        states.rows.write.mode("overwrite").parquet(f"{root}/states/batch={batch_id}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream_states(spark: SparkSession, spec: ReportSpec, root: str) -> States:
    """The states of all periods seen so far."""
    return merged(States(spec.dims, spec.targets, spark.read.parquet(f"{root}/states").drop("batch")), ["period_start"])
