"""Metrics with mergeable states.

A *flat* metric has one state column per row of the cube: ``init`` aggregates raw
values to a state, ``merge`` aggregates states, ``final`` turns a state into the
value shown.  A *keyed* metric has state rows beside a group's flat row, one for
each key (a distinct value, a bucket, a word of a bitmap); a state is one integer,
a count or 64 bits.  So no state outgrows a row, none is larger than the record it
comes from, and hot groups are combined before the shuffle like any aggregate.
``entry`` gives a value's key, ``show`` aggregates a group's state rows to the value
shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.plans.spec import SpecError, Target, parse_range

KEY, WORD, BITS, COUNT = "_key", "_word", "_bits", "_count"


@dataclass(frozen=True)
class FlatMetric:
    name: str
    cast: str | None
    init: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    final: Callable[[Column], Column]
    keyed = False


@dataclass(frozen=True)
class KeyedMetric:
    """State rows have ``COUNT``, how often their ``KEY`` was seen, or ``BITS``, the ids seen in their ``WORD``."""

    name: str
    entry: Callable[[Column], tuple[Column, Column, Column]]  # KEY, WORD and BITS; KEY and WORD are NULL if the value takes no part
    show: Callable[[Column], Column]  # an aggregate of the state rows for which the condition holds
    top: int = 0  # only the keys with the largest counts are shown; 0: all
    keyed = True


def _same(c: Column) -> Column:
    return c


def _extreme(agg: Callable[[Column], Column]) -> Callable[[str, str | None], FlatMetric]:
    return lambda name, _: FlatMetric(name, "number", agg, agg, _same)


def _avg(name: str, _: str | None) -> FlatMetric:
    def init(c: Column) -> Column:
        return F.when(F.count(c) > 0, F.struct(F.sum(c).alias("s"), F.count(c).alias("n")))

    def merge(c: Column) -> Column:
        return F.when(F.count(c) > 0, F.struct(F.sum(c["s"]).alias("s"), F.sum(c["n"]).alias("n")))

    return FlatMetric(name, "number", init, merge, lambda c: c["s"].cast("double") / F.nullif(c["n"], F.lit(0)))


def _sketch(lg: int) -> Callable[[str, str | None], FlatMetric]:
    def make(name: str, _: str | None) -> FlatMetric:
        present = lambda c, made: F.when(F.count(c) > 0, made)
        return FlatMetric(name, "string", lambda c: present(c, F.hll_sketch_agg(c, lg)), lambda c: present(c, F.hll_union_agg(c, F.lit(False))), F.hll_sketch_estimate)

    return make


def _json_pairs(pairs: Column) -> Column:
    """Ordered (text, count) pairs as a JSON object; ``to_json`` writes and escapes each key."""
    one = lambda p: F.concat(F.regexp_extract(F.to_json(F.struct(p["k"].alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"), p["n"].cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, one), ","), F.lit("}"))


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _pairs(own: Column, order: Column) -> Column:
    """The group's (key, count) pairs in order; NULL if it has none."""
    pairs = F.array_sort(F.collect_list(F.when(own, F.struct(order.alias("o"), F.col(KEY).alias("k"), F.col(COUNT).alias("n")))))
    return F.when(F.size(pairs) > 0, _json_pairs(pairs))


def _value_dist(name: str, param: str | None) -> KeyedMetric:
    return KeyedMetric(name, lambda c: (c.cast("string"), _no("bigint"), _no("bigint")), lambda own: _pairs(own, -F.col(COUNT)), int(param or 0))


def _range_dist(name: str, param: str | None) -> KeyedMetric:
    low, step, high = parse_range(param)
    last = int((high - low) / step) + 1
    head = f"min:{low},interval:{step},max:{high},"

    def entry(c: Column) -> tuple[Column, Column, Column]:
        v = c.try_cast("double")
        # a value between the ends counts its steps from zero, not from the least value
        between = (v / step).cast("int") + 1
        return F.when(v < low, 0).when(v > high, last).when(v.isNotNull() & ~F.isnan(v), between).cast("string"), _no("bigint"), _no("bigint")

    return KeyedMetric(name, entry, lambda own: F.concat(F.lit(head), _pairs(own, F.col(KEY).cast("int"))))


def _uv_bitmap(name: str, _: str | None) -> KeyedMetric:
    """Exact distinct count of non-negative integers: a word for each block of 64 ids."""

    def entry(c: Column) -> tuple[Column, Column, Column]:
        v = c.try_cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), v.bitwiseAND(F.lit(63)).cast("int"))
        return _no("string"), F.when(v >= 0, F.shiftright(v, 6)), bit

    return KeyedMetric(name, entry, lambda own: F.sum(F.when(own, F.bit_count(BITS)).cast("bigint")))


REGISTRY: dict[str, Callable[[str, str | None], FlatMetric | KeyedMetric]] = {
    "SUM": _extreme(F.sum),
    "MAX": _extreme(F.max),
    "MIN": _extreme(F.min),
    "AVG": _avg,
    "VALUEDIST": _value_dist,
    "RANGEDIST": _range_dist,
    "UVBITMAP": _uv_bitmap,
    "UV_HYPERLOGLOG": _sketch(13),
    "UV_HYPERLOGLOGPLUS": _sketch(14),
}


def metric(target: Target) -> FlatMetric | KeyedMetric:
    if target.type not in REGISTRY:
        raise SpecError(f"{target.name}: metric type {target.type} isn't supported")
    return REGISTRY[target.type](target.name, target.param)


def prepared(value: Column, kind: str | None, type_name: str) -> Column:
    """A raw value as its metric takes it: integers as bigint, other numbers as double, text for sketches."""
    if kind == "number":
        return value.cast("bigint") if type_name in ("tinyint", "smallint", "int", "bigint", "boolean") else value.cast("double")
    return value.cast("string") if kind == "string" else value
