"""The cube: every permitted roll-up of a report's dimensions, with mergeable states.

    base cuboid   one partial aggregation over the input, grouped by all dimensions
    cube          each base row joins the roll-ups whose filters it passes; one merge
    roll-up       states of finer periods, merged by key
    finalize      states to values

A roll-up writes the literal ``ALL`` into the dimensions it leaves out, so a value
``ALL`` in the data and the roll-up are one group by construction.  Filters decide
only whether a row joins a roll-up; base rows are never dropped.

Each record becomes one row for all flat metrics and one for each keyed metric that
has a value, in one pass: however many metrics a report has, its input is scanned
once and its states are one table that is shuffled once for each step.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.metrics import BITS, COUNT, KEY, WORD, FlatMetric, KeyedMetric, metric, prepared
from latticework.plans.cuboid import CuboidPlan, resolve
from latticework.plans.spec import Filter, ReportSpec, Rule, SpecError, Target

ALL, EMPTY = "ALL", "EMPTY"
ROWS = "_rows"
METRIC, FLAT = "_metric", ""  # whose state a row has: a keyed metric's, or (FLAT) all flat ones'
_STATE = (METRIC, KEY, WORD)

Lists = Mapping[str, "Sequence[str] | DataFrame"]


@dataclass
class States:
    """Mergeable states of one report: for each key a flat row, and rows of the keyed metrics if there are any."""

    dims: list[str]
    targets: tuple[Target, ...]
    rows: DataFrame

    @property
    def extra(self) -> list[str]:
        """Key columns besides the dimensions, such as a period."""
        return [c for c in self.rows.columns if c not in {*self.dims, ROWS, *_STATE, BITS, COUNT, *(t.name for t in self.targets)}]

    @property
    def flat(self) -> DataFrame:
        """The flat rows alone."""
        keyed = METRIC in self.rows.columns
        return self.rows.where(F.col(METRIC) == FLAT).drop(*_STATE, BITS, COUNT) if keyed else self.rows


def _metrics(targets: Iterable[Target]) -> tuple[list[FlatMetric], list[KeyedMetric]]:
    found = [metric(t) for t in targets]
    return [m for m in found if not m.keyed], [m for m in found if m.keyed]


def projected(df: DataFrame, dims: Sequence[str], targets: Sequence[Target], keep: Sequence[str] = (), values: Mapping[str, str] | None = None) -> DataFrame:
    """Dimensions as text (NULL becomes ``EMPTY``), target inputs under their names, and ``keep``."""
    values = values or {}
    expression = lambda name: F.expr(values[name]) if values.get(name) else F.col(f"`{name}`")
    inputs = [F.expr(t.value) if t.value else F.col(f"`{t.name}`") for t in targets]
    kinds = [kind for _, kind in df.select(*(c.alias(f"t{i}") for i, c in enumerate(inputs))).dtypes]
    columns = [F.coalesce(expression(d).cast("string"), F.lit(EMPTY)).alias(d) for d in dims]
    for t, value, kind in zip(targets, inputs, kinds, strict=True):
        made = metric(t)
        columns.append((value if made.keyed else prepared(value, made.cast, kind)).alias(t.name))
    return df.select(*keep, *columns)


def _entries(df: DataFrame, keys: Sequence[str], flat: Sequence[FlatMetric], keyed: Sequence[KeyedMetric]) -> DataFrame:
    """Each record as a flat row and a row for each keyed metric it has a value of."""
    none = F.lit(None)
    entry = lambda name, key, word, bits: F.struct(F.lit(name).alias(METRIC), key.cast("string").alias(KEY), word.cast("bigint").alias(WORD), bits.cast("bigint").alias(BITS))
    entries = [entry(FLAT, none, none, none), *(entry(m.name, *m.entry(F.col(m.name))) for m in keyed)]
    out = df.select(*keys, *(m.name for m in flat), F.explode(F.array(*entries)).alias("_e"))
    out = out.select(*keys, *(F.when(F.col(f"_e.{METRIC}") == FLAT, F.col(m.name)).alias(m.name) for m in flat), "_e.*")
    return out.where((F.col(METRIC) == FLAT) | F.col(KEY).isNotNull() | F.col(WORD).isNotNull())


def base_cuboid(df: DataFrame, dims: Sequence[str], targets: Sequence[Target], extra: Sequence[str] = ()) -> States:
    """Grouped by all dimensions (and ``extra`` columns such as a period)."""
    flat, keyed = _metrics(targets)
    keys = [*extra, *dims]
    states = [m.init(F.col(m.name)).alias(m.name) for m in flat]
    if not keyed:
        return States(list(dims), tuple(targets), df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS), *states))
    rows = _entries(df, keys, flat, keyed).groupBy(*keys, *_STATE)
    counted = F.count(F.when(F.col(METRIC) == FLAT, 1)).alias(ROWS), F.count(KEY).alias(COUNT), F.bit_or(BITS).alias(BITS)
    return States(list(dims), tuple(targets), rows.agg(*counted, *states))


def _said(rule: Filter) -> Column:
    return F.col(rule.dim) if not rule.related else F.concat(F.col(rule.related), F.lit("\t"), F.col(rule.dim))


def _joined(rule: Filter, lists: Lists) -> bool:
    return isinstance(lists.get(rule.config or ""), DataFrame)


def _flag(rule: Filter) -> str:
    return f"_listed_{rule.dim}"


def _passes(rule: Filter, lists: Lists) -> Column:
    listed = F.col(_flag(rule)) if _joined(rule, lists) else _said(rule).isin(*_values(rule, lists))
    return listed if rule.kind == "WList" else ~listed


def _values(rule: Filter, lists: Lists) -> list[str]:
    if rule.values is not None:
        return list(rule.values)
    if rule.config not in lists:
        raise SpecError(f"the configured list {rule.config!r} wasn't loaded")
    return list(lists[rule.config])


def _with_flags(df: DataFrame, plan: CuboidPlan, lists: Lists) -> DataFrame:
    """A flag for each filter whose list is a table: joined on equal values, whatever its size."""
    for rule in plan.filters.values():
        if _joined(rule, lists):
            listed = lists[rule.config]
            side = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
            df = df.withColumn("_said", _said(rule)).join(side, F.col("_said") == F.col("_listed"), "left")
            df = df.withColumn(_flag(rule), F.col("_listed").isNotNull()).drop("_said", "_listed")
    return df


def _lattice(df: DataFrame, plan: CuboidPlan, lists: Lists) -> DataFrame:
    """Each row once for every roll-up it joins, with ``ALL`` in the dimensions rolled up."""
    df = _with_flags(df, plan, lists)
    options = []
    for up in plan.roll_ups():
        key = F.struct(*(F.lit(ALL).alias(d) if d in up.dims else F.col(d) for d in plan.dims))
        options.append(F.when(reduce(Column.__and__, (_passes(f, lists) for f in up.filters)), key) if up.filters else key)
    flags = [_flag(r) for r in plan.filters.values() if _joined(r, lists)]
    others = [c for c in df.columns if c not in plan.dims and c not in flags]
    if len(options) == 1:
        return df.drop(*flags)
    out = df.select(*others, F.explode(F.array(*options)).alias("_up"))
    if plan.filters:
        out = out.where(F.col("_up").isNotNull())
    return out.select(*others, *(F.col(f"_up.{d}").alias(d) for d in plan.dims))


def merged(states: States, extra: Sequence[str] | None = None) -> States:
    """States with equal keys merged; ``extra`` replaces the key columns besides the dimensions."""
    flat, keyed = _metrics(states.targets)
    keys = [*(states.extra if extra is None else extra), *states.dims]
    sums = [F.sum(ROWS).alias(ROWS), *(m.merge(F.col(m.name)).alias(m.name) for m in flat)]
    if keyed:
        keys += _STATE
        sums += [F.sum(COUNT).alias(COUNT), F.bit_or(BITS).alias(BITS)]
    return States(states.dims, states.targets, states.rows.groupBy(*keys).agg(*sums))


def cube_states(df: DataFrame, dims: Sequence[str], targets: Sequence[Target], rules: Sequence[Rule] = (), lists: Lists | None = None, extra: Sequence[str] = (), pre_aggregate: bool = True) -> States:
    """The cube of projected rows.

    The base cuboid comes first, so that the lattice multiplies groups, not rows.
    Where there are nearly as many groups as rows, ``pre_aggregate=False`` saves
    that shuffle: rows are multiplied, combined before the one shuffle left.
    """
    dims, plan, lists = sorted(dims), resolve(dims, rules), lists or {}
    if not pre_aggregate:
        return base_cuboid(_lattice(df, plan, lists), dims, targets, extra)
    base = base_cuboid(df, dims, targets, extra)
    return merged(States(base.dims, base.targets, _lattice(base.rows, plan, lists)), list(extra))


def _largest(rows: DataFrame, keys: Sequence[str], keyed: Sequence[KeyedMetric]) -> DataFrame:
    """Without the state rows beyond a metric's top.

    All other rows are alone in their window, so one limit holds for all, and Spark
    applies it before the shuffle too: a group's rare values stay where they are.
    """
    tops = {m.name: m.top for m in keyed if m.top > 0}
    if not tops:
        return rows
    limited = F.col(METRIC).isin(*tops)
    alone = F.when(~limited, F.coalesce(F.col(KEY), F.col(WORD).cast("string")))
    ranked = rows.withColumn("_alone", alone).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, METRIC, "_alone").orderBy(F.col(COUNT).desc(), KEY)))
    ranked = ranked.where(F.col("_rank") <= max(tops.values()))
    for name, top in tops.items():
        ranked = ranked.where((F.col(METRIC) != name) | (F.col("_rank") <= top))
    return ranked.drop("_alone", "_rank")


def finalize(states: States, report: str | None = None) -> DataFrame:
    """The values shown: key columns, then each target in its order. A target without any value is NULL."""
    flat, keyed = _metrics(states.targets)
    keys = [*states.extra, *states.dims]
    values = [m.final(F.col(m.name)).alias(m.name) for m in flat]
    if not keyed:
        out = states.rows.select(*keys, *values)
    else:
        rows = _largest(states.rows, keys, keyed).select(*keys, *_STATE, BITS, COUNT, *values)
        # one row of a group has its flat values, the others none
        out = rows.groupBy(*keys).agg(*(F.max(m.name).alias(m.name) for m in flat), *(m.show(F.col(METRIC) == m.name).alias(m.name) for m in keyed))
    out = out.select(*keys, *(t.name for t in states.targets))
    return out.withColumn("report", F.lit(report)) if report else out


def cube(df: DataFrame, dims: Sequence[str], targets: Sequence[Target], rules: Sequence[Rule] = (), lists: Lists | None = None) -> DataFrame:
    """The finished cube of a frame that has the dimensions and targets as columns."""
    return finalize(cube_states(projected(df, sorted(dims), targets), dims, targets, rules, lists))


def report_states(df: DataFrame, spec: ReportSpec, lists: Lists | None = None, extra: Sequence[str] = ()) -> States:
    """The cube of a report over transformed rows (columns named as dimensions and targets, or their ``value`` expressions)."""
    values = {d.name: d.value for d in spec.dimensions if d.value}
    rows = projected(df, spec.dims, spec.targets, extra, values)
    return cube_states(rows, spec.dims, spec.targets, spec.rules, lists, extra)
