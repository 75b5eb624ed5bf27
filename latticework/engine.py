"""Running reports: from definitions and a period to stored states and exported rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from latticework.operators.cube import States, cube_states, finalize, merged, projected
from latticework.plans.frequency import Frequency, format_period
from latticework.plans.schedule import Plan, Unit, Work, build, strict_checks
from latticework.plans.spec import ReportSpec, SpecError
from latticework.sinks.store import PERIOD, StateStore, period_name, with_period
from latticework.sources.lists import load_lists
from latticework.sources.paths import resolve, strictest
from latticework.sources.readers import nested_columns, read


@dataclass(frozen=True)
class Context:
    """What a transform may ask for besides its records. Where a job's periods share one scan, ``start`` is the first's."""

    start: datetime
    freq: Frequency
    lists: Mapping[str, list[str] | DataFrame]
    shared: Mapping[str, object] = field(default_factory=dict)

    @property
    def report_date(self) -> str:
        return format_period(self.start)


PERIODS = 1024  # periods of one grain that run as one job, at most
SCANS = 64  # the same where each period has its own transform, and so a scan of its own in the plan


class RunError(RuntimeError):
    """Some units failed; ``failures`` has each with its exception."""

    def __init__(self, failures: dict[str, BaseException]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in failures.items()))
        self.failures = failures


class Engine:
    """Runs reports over a state store. It keeps no state of its own, so runs may overlap."""

    def __init__(self, spark: SparkSession, store: str, base_dir: str | None = None, shared: Mapping[str, object] | None = None, threads: int = 4):
        self.spark, self.store, self.base_dir = spark, StateStore(spark, store), base_dir
        self.shared, self.threads = dict(shared or {}), threads

    # -- one job ----------------------------------------------------------------

    def _rows(self, records: DataFrame, work: Work, lists: Mapping) -> DataFrame:
        """Records, with their ``PERIOD``, as the report's dimensions, target inputs and period."""
        spec, context = work.spec, Context(work.start, work.freq, lists, self.shared)
        rows = spec.transform(records, context) if spec.transform else records
        if PERIOD not in rows.columns:
            if spec.across_periods:
                raise SpecError(f"{spec.name}: its transform must keep the column {PERIOD}")
            rows = with_period(rows, work.start)
        return projected(rows, spec.dims, spec.targets, [PERIOD], {d.name: d.value for d in spec.dimensions if d.value})

    def raw_states(self, records: Sequence[DataFrame], works: Sequence[Work]) -> States:
        """The states of one report's periods, from the records of all or of each."""
        spec = works[0].spec
        lists = [load_lists(self.spark, spec.configs, w.start, self.base_dir) for _, w in zip(records, works)]  # noqa: B905
        rows = [self._rows(r, w, some) for r, w, some in zip(records, works, lists)]  # noqa: B905
        every = lambda some: reduce(DataFrame.unionByName, some)
        if not spec.configs:
            return cube_states(every(rows), spec.dims, spec.targets, spec.rules, {}, [PERIOD])
        # configured lists are a period's own
        parts = [cube_states(r, spec.dims, spec.targets, spec.rules, some, [PERIOD]) for r, some in zip(rows, lists, strict=True)]
        return States(spec.dims, spec.targets, every([p.rows for p in parts]))

    def merged_states(self, works: Sequence[Work]) -> States:
        """States of the finer periods within each of one report's periods, merged; finer ones that don't exist are left out."""
        spec, freq = works[0].spec, works[0].freq
        if freq.child is None:
            raise SpecError(f"{spec.name}: nothing is finer than {freq.value}")
        parts = {w.start: self.store.present(spec, freq.child, freq.children(w.start)) for w in works}
        for start, there in parts.items():
            if not there:
                raise FileNotFoundError(f"{spec.name}: no {freq.child.value} states for {freq.value} {format_period(start)}")
        states = self.store.read(spec, freq.child, sorted({s for there in parts.values() for s in there}), with_period=True)
        pairs = [(period_name(child), period_name(start)) for start, there in parts.items() for child in there]
        within = self.spark.createDataFrame(pairs, "_child string, _parent string")  # a row for each of the finer periods
        rows = states.rows.join(F.broadcast(within), F.col(PERIOD) == F.col("_child")).withColumn(PERIOD, F.col("_parent")).drop("_child", "_parent")
        return merged(States(spec.dims, spec.targets, rows))

    def run_units(self, units: Sequence[Unit]) -> dict[tuple, BaseException]:
        """Runs units of the same reports and grain: one scan of the input for all reports,
        and one job for all periods of a report.  If a job fails, its periods are tried one
        by one, so only the bad ones fail.  Gives the work that failed."""
        failed: dict[tuple, BaseException] = {}
        raw = units[0].works[0].raw
        found: list[Unit] = []
        paths: list[list[str]] = []
        for unit in units:
            try:
                if raw:
                    paths.append(self._paths(unit))
                found.append(unit)
            except Exception as e:
                failed |= {w.key: e for w in unit.works}
        if not found:
            return failed
        held: list[DataFrame] = []
        again: list[int] = []
        try:
            records: list[DataFrame] | BaseException = []
            try:
                records = self._records(found, paths, held) if raw else []
            except Exception as e:
                records = e
            for n in range(len(found[0].works)):
                works = [u.works[n] for u in found]
                try:
                    if isinstance(records, BaseException):
                        raise records
                    states = self.raw_states(records, works) if raw else self.merged_states(works)
                    self.store.write(works[0].spec, works[0].freq, [w.start for w in works], states)
                except Exception as e:
                    if len(works) == 1:
                        failed[works[0].key] = e
                    else:
                        again.append(n)
        finally:
            for r in held:
                r.unpersist()
        for n in again:
            for unit in found:
                failed |= self.run_units([Unit([unit.works[n]])])
        return failed

    def _paths(self, unit: Unit) -> list[str]:
        first = unit.works[0]
        if first.spec.input is None:
            raise SpecError(f"{first.spec.name}: it has no input")
        return resolve(self.spark, first.spec.input, first.start, first.freq.end(first.start), self.base_dir, strictest(strict_checks(unit.works)))

    def _records(self, units: Sequence[Unit], paths: Sequence[Sequence[str]], held: list[DataFrame]) -> list[DataFrame]:
        """The input's records with their period: one frame of all periods, or one of each where a transform sees its period alone."""
        first = units[0].works[0].spec.input
        if one_scan(units[0]):
            # a row for each path of the periods; a file that belongs to several gives its records to each
            named = self.spark.createDataFrame([(p, period_name(u.works[0].start)) for u, some in zip(units, paths, strict=True) for p in some], f"_path string, {PERIOD} string")
            every = read(self.spark, replace(first, fields=()), list(dict.fromkeys(p for some in paths for p in some)))
            file = F.col("_metadata.file_path")
            parent, itself = F.broadcast(named), F.broadcast(named.withColumnsRenamed({"_path": "_file", PERIOD: "_own"}))
            out = every.withColumn("_at", file).join(parent, F.regexp_replace("_at", "/[^/]*$", "") == F.col("_path"), "left").join(itself, F.col("_at") == F.col("_file"), "left")
            out = out.withColumn(PERIOD, F.coalesce(PERIOD, "_own", F.raise_error(F.concat(F.lit("a file of no period: "), "_at")))).drop("_at", "_path", "_file", "_own")
            frames = [nested_columns(out, [*first.fields, PERIOD]) if first.fields else out]
        else:
            frames = [with_period(read(self.spark, first, some), u.works[0].start) for u, some in zip(units, paths, strict=True)]
        if len(units[0].works) > 1:
            frames = [self._held(u, r, held) for u, r in zip(units, frames)]  # noqa: B905
        return frames

    def _held(self, unit: Unit, records: DataFrame, held: list[DataFrame]) -> DataFrame:
        """The records held for all reports of the unit: only the columns that a report reads; the others, NULL, cost nothing."""
        try:
            parts = [self._rows(records, w, load_lists(self.spark, w.spec.configs, w.start, self.base_dir)) for w in unit.works]
            used = {PERIOD} | {c for p in parts for c in columns_read(p)}
        except Exception:  # a report that can't be planned fails by itself, later
            used = set(records.columns)
        kept = records.select(*(F.col(f"`{f.name}`") if f.name in used else F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields))
        held.append(kept.persist(StorageLevel.MEMORY_AND_DISK))
        return kept

    # -- many -------------------------------------------------------------------

    def plan(self, specs: Iterable[ReportSpec], freq: Frequency, start: datetime | Iterable[datetime], force: bool = False) -> Plan:
        works = []
        for spec in specs:
            spec.validate()
            works += [Work(spec, freq, s) for s in ([start] if isinstance(start, datetime) else start)]
        there: dict[tuple, set[str]] = {}

        def exists(w: Work) -> bool:
            if w.key[:2] not in there:  # one listing a report and grain
                there[w.key[:2]] = self.store.published(w.spec, w.freq)
            return period_name(w.start) in there[w.key[:2]]

        return build(works, exists, force)

    @staticmethod
    def _jobs(units: Sequence[Unit], ready: Sequence[int]) -> list[list[int]]:
        """The wave's units in jobs: the periods of the same reports and grain together."""
        alike: dict[tuple, list[int]] = {}
        for i in ready:
            works = units[i].works
            alike.setdefault((works[0].freq, works[0].raw, tuple(w.spec.name for w in works)), []).append(i)
        most = lambda i: PERIODS if not units[i].works[0].raw or one_scan(units[i]) else SCANS
        return [some[at : at + most(some[0])] for some in alike.values() for at in range(0, len(some), most(some[0]))]

    def run(self, specs: Iterable[ReportSpec], freq: Frequency, start: datetime | Iterable[datetime], force: bool = False, export: Callable[[Work, DataFrame], None] | None = None) -> list[Work]:
        """Runs what is missing for one period or several, in waves; jobs of a wave run at once in one session.

        ``export`` gets each finished work and its rows as soon as its job ends; exports
        run at once too, so it must stand that (``JdbcSink`` does).  A failed period holds
        up what depends on it, not its neighbours; RunError tells of every failure at the end.
        """
        plan = self.plan(specs, freq, start, force)
        failures: dict[str, BaseException] = {}
        done: list[Work] = []
        bad: set[int] = set()

        def shown(w: Work) -> BaseException | None:
            try:
                export(w, self.result(w.spec, w.freq, w.start))
            except Exception as e:
                return e
            return None

        with ThreadPoolExecutor(self.threads) as pool, ThreadPoolExecutor(self.threads) as exports:
            for wave in plan.levels():
                ready = [i for i in wave if not plan.units[i].after & bad]
                bad |= set(wave) - set(ready)
                jobs = [(job, pool.submit(self.run_units, [plan.units[i] for i in job])) for job in self._jobs(plan.units, ready)]
                for job, future in jobs:
                    failed = future.result()
                    works = [(i, w) for i in job for w in plan.units[i].works]
                    if export:
                        out = [(w, exports.submit(shown, w)) for _, w in works if w.key not in failed]
                        failed |= {w.key: e for w, f in out if (e := f.result())}
                    for i, w in works:
                        if w.key in failed:
                            bad.add(i)
                            failures[f"{w.spec.name} {w.freq.value} {format_period(w.start)}"] = failed[w.key]
                        else:
                            done.append(w)
        if failures:
            raise RunError(failures)
        return done

    def result(self, spec: ReportSpec, freq: Frequency, start: datetime | Iterable[datetime]) -> DataFrame:
        """The finished rows of a stored period; of several, with the column ``PERIOD``."""
        if isinstance(start, datetime):
            return finalize(self.store.read(spec, freq, [start]))
        return finalize(self.store.read(spec, freq, list(start), with_period=True))


def one_scan(unit: Unit) -> bool:
    """Whether a scan of several periods' files gives each report what it needs: a transform that
    sees one period at a time, a period's own lists, or records without a file stand against it."""
    specs = [w.spec for w in unit.works]
    return all((s.transform is None or s.across_periods) and not s.configs for s in specs) and specs[0].input is not None and specs[0].input.file_type in ("text", "parquet", "orc")


def columns_read(df: DataFrame) -> set[str]:
    """The columns that a plan's file scans read after pruning."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    every = [leaves.apply(i) for i in range(leaves.size())]
    return {name for leaf in every if leaf.nodeName().startswith("Scan") and "Scan" in leaf.getClass().getSimpleName() for name in leaf.requiredSchema().fieldNames()}
