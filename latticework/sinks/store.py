"""The state store: Parquet by report and grain, published period by period.

    <root>/report=R/freq=F/data/<version>/                        state rows of the periods of one write
    <root>/report=R/freq=F/published/<period>~<number>~<version>  an empty file: where the period is

All periods of a write are one job and a few files.  Once these are whole, each
period is published by an empty file that names them; of several the one with the
largest number holds.  Readers meet the old version or the new one, never an empty or
half-written period; a failed write changes nothing, a run repeated leaves the same
state, and one listing tells which periods there are.  Versions that no period has had
since before a write began go with that write, if they are older than ``KEEP``.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.cube import States
from latticework.plans.frequency import Frequency, format_period
from latticework.plans.spec import ReportSpec

PERIOD = "period_start"  # the key column that tells a state row's period, by ``period_name``
KEEP = timedelta(hours=1)  # how long who reads a replaced version may go on
_NAME = "%Y-%m-%dT%H-%M"


def period_name(start: datetime) -> str:
    """A period as ``PERIOD`` holds it."""
    return start.strftime(_NAME)


def period_time(name: Column | str = PERIOD) -> Column:
    """The start of the period that ``PERIOD`` names."""
    return F.to_timestamp(F.col(name) if isinstance(name, str) else name, "yyyy-MM-dd'T'HH-mm")


def with_period(rows: DataFrame, start: datetime) -> DataFrame:
    return rows.withColumn(PERIOD, F.lit(period_name(start)))


class StateStore:
    def __init__(self, spark: SparkSession, root: str, keep: timedelta = KEEP):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _place(self, spec: ReportSpec, freq: Frequency) -> str:
        return f"{self.root}/report={spec.name}/freq={freq.value}"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        at = self._path(self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        """The names in a folder, all fetched from the JVM as one text."""
        fs, at, jvm = self._files(), self._path(folder), self.spark._jvm
        if not fs.exists(at):
            return []
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(at)))
        return re.findall(rf"/{folder.rpartition('/')[2]}/([^/,}}]+)(?=[,}}])", text)

    def _published(self, spec: ReportSpec, freq: Frequency) -> dict[str, list[tuple[int, str]]]:
        """For each period its (number, version) pairs, the one that holds last."""
        out: dict[str, list[tuple[int, str]]] = {}
        for name in self._listed(f"{self._place(spec, freq)}/published"):
            if name.count("~") == 2:
                period, number, version = name.split("~")
                out.setdefault(period, []).append((int(number), version))
        return {p: sorted(some) for p, some in out.items()}

    def published(self, spec: ReportSpec, freq: Frequency) -> set[str]:
        """The names of the periods that are there."""
        return set(self._published(spec, freq))

    def exists(self, spec: ReportSpec, freq: Frequency, start: datetime) -> bool:
        return bool(self.present(spec, freq, [start]))

    def present(self, spec: ReportSpec, freq: Frequency, starts: Sequence[datetime]) -> list[datetime]:
        """Those of the periods that were published."""
        there = self._published(spec, freq)
        return [s for s in starts if period_name(s) in there]

    def write(self, spec: ReportSpec, freq: Frequency, starts: Sequence[datetime], states: States) -> None:
        """Replaces these periods' states; ``states`` has the key column ``PERIOD``.  A period without rows is there all the same."""
        fs, place, version = self._files(), self._place(spec, freq), f"{int(time.time())}-{uuid.uuid4().hex}"
        before = {v for some in self._published(spec, freq).values() for _, v in some}
        try:
            # few files, a large period in several, and a period's rows together
            states.rows.hint("rebalance", PERIOD).sortWithinPartitions(PERIOD).write.parquet(f"{place}/data/{version}")
        except Exception:
            fs.delete(self._path(f"{place}/data/{version}"), True)
            raise
        now = self._published(spec, freq)

        def publish(start: datetime) -> None:
            old = now.get(period_name(start), [])
            number = max((n for n, _ in old), default=0) + 1
            fs.create(self._path(f"{place}/published/{period_name(start)}~{number}~{version}"), True).close()
            for n, v in old:
                fs.delete(self._path(f"{place}/published/{period_name(start)}~{n}~{v}"), False)

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(publish, starts))
        used = {v for some in self._published(spec, freq).values() for _, v in some}
        for name in self._listed(f"{place}/data"):
            if name not in used | before | {version} and int(name.partition("-")[0]) < time.time() - self.keep.total_seconds():
                fs.delete(self._path(f"{place}/data/{name}"), True)

    def read(self, spec: ReportSpec, freq: Frequency, starts: Sequence[datetime], with_period: bool = False) -> States:
        """The states of these periods together; ``with_period`` keeps ``PERIOD`` as a key column."""
        there, place = self._published(spec, freq), self._place(spec, freq)
        by_version: dict[str, list[str]] = {}
        for s in starts:
            if period_name(s) not in there:
                raise FileNotFoundError(f"{spec.name}: no {freq.value} states for {format_period(s)}")
            by_version.setdefault(there[period_name(s)][-1][1], []).append(period_name(s))
        # a version's other periods may be another's by now: the filter is the version's own, and reaches its scan
        parts = [self.spark.read.parquet(f"{place}/data/{v}").where(F.col(PERIOD).isin(names)) for v, names in sorted(by_version.items())]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return States(spec.dims, spec.targets, rows if with_period else rows.drop(PERIOD))

    def describe(self, spec: ReportSpec, freq: Frequency, start: datetime) -> dict[str, object]:
        """How complete a merged period is: its children, and how many are there."""
        children = freq.children(start) if freq.coarser_than(spec.min_freq) else []
        return {"report": spec.name, "freq": freq.value, "start": format_period(start), "children": len(children), "present": len(self.present(spec, freq.child, children)) if children else 0}
