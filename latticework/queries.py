"""The registered report queries and, beside each, its SQL in the naive form: one
SELECT for each roll-up, joined by UNION ALL."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from datetime import datetime, timedelta, timezone
from functools import reduce
from itertools import combinations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.engine import Engine
from latticework.functions import accessors as A
from latticework.functions.rows import emit_rows
from latticework.operators.cube import cube, cube_states, finalize, merged, projected, report_states
from latticework.plans.frequency import Frequency, format_period
from latticework.plans.spec import Bind, ConfigSource, Dimension, Filter, Ignore, InputSpec, OutputSpec, ReportSpec, Target, TopFilter, from_xml
from latticework.scratch import fresh_folder
from latticework.sinks.export import JdbcSink, TableColumn, project, reject_rows, rejects, top_rows
from latticework.sinks.store import PERIOD, period_time
from latticework.sources.lists import load_lists
from latticework.sources.paths import MissingInput, expand, matching, resolve
from latticework.sources.readers import nested_columns, read, with_file
from latticework.streaming.increments import read_stream_states, start_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL for comparison ------------------------------------------------------------

Sets = Sequence[tuple[tuple[str, ...], str | None]]


def subsets(dims: Sequence[str]) -> list[tuple[tuple[str, ...], None]]:
    return [(some, None) for n in range(len(dims) + 1) for some in combinations(dims, n)]


def lattice_sql(base: str, dims: Sequence[str], metrics: str, sets: Sets, having: str = "COUNT(*) > 0") -> str:
    """A SELECT for each (rolled-up dimensions, condition), joined by UNION ALL."""
    parts = []
    for rolled, where in sets:
        shown = ", ".join(f"'ALL' AS {d}" if d in rolled else d for d in dims)
        kept = ", ".join(d for d in dims if d not in rolled)
        parts.append(f"SELECT {shown}, {metrics} FROM base" + (f" WHERE {where}" if where else "") + (f" GROUP BY {kept}" if kept else f" HAVING {having}"))
    return f"WITH base AS ({base}) " + " UNION ALL ".join(parts)


def sums(*names: str) -> str:
    return ", ".join(f"CAST(SUM({n}) AS BIGINT) AS {n}" for n in names)


def cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def cents_sql(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


# -- cubes -------------------------------------------------------------------------

_LINE = f"SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, {cents_sql('l_extendedprice')} AS price FROM lineitem"
QUANTITY, PRICE = Target("quantity", "SUM"), Target("price", "SUM")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"), cents("l_extendedprice").alias("price"))


@registered(lattice_sql(_LINE, ("l_linestatus", "l_returnflag"), sums("price", "quantity"), [((), None)]))
def base_cuboid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions ignored by the roll-up: the base cuboid alone."""
    dims = ["l_linestatus", "l_returnflag"]
    return cube(lines(spark, sf_dir), dims, [PRICE, QUANTITY], [Ignore(tuple(dims))])


@registered(lattice_sql(_LINE, ("l_linestatus", "l_returnflag"), sums("price", "quantity"), subsets(("l_linestatus", "l_returnflag"))))
def cube_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), ["l_linestatus", "l_returnflag"], [PRICE, QUANTITY])


_THREE = ("l_linenumber", "l_linestatus", "l_returnflag")


@registered(lattice_sql(_LINE, _THREE, sums("price", "quantity"), subsets(_THREE)))
def cube_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), _THREE, [PRICE, QUANTITY])


_ORDERS = f"SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderpriority AS priority, o_orderstatus AS status, CAST(o_custkey % 7 AS VARCHAR) AS part, {cents_sql('o_totalprice')} AS total FROM orders"


@registered(lattice_sql(_ORDERS, ("part", "priority", "status", "year"), sums("total") + ", CAST(COUNT(*) AS BIGINT) AS orders", subsets(("part", "priority", "status", "year"))))
def cube_4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("part"), cents("o_totalprice").alias("total"), F.lit(1).alias("orders"))
    return cube(df, ["part", "priority", "status", "year"], [Target("total", "SUM"), Target("orders", "SUM")])


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), [(s, None) for s in ((), ("l_linenumber",), ("l_returnflag",), ("l_linenumber", "l_returnflag"))]))
def cube_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Ignore(("L_LINESTATUS",))])


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), [(s, None) for s in ((), ("l_linenumber",), ("l_linestatus", "l_returnflag"), _THREE)]))
def cube_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Bind(("l_returnflag", "l_linestatus"))])


_EVENT = f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, {cents_sql('value')} AS value FROM events"
VALUE = Target("value", "SUM")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", cents("value").alias("value"), "ts")


def _one_filter(condition: str) -> Sets:
    return [((), None), (("day",), None), (("event_type",), condition), (("day", "event_type"), condition)]


@registered(lattice_sql(_EVENT, ("day", "event_type"), sums("value"), _one_filter("event_type IN ('click', 'view')")))
def cube_wlist1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(events(spark, sf_dir), ["day", "event_type"], [VALUE], [Filter("event_type", "WList", ("click", "view"))])


@registered(lattice_sql(_EVENT, ("day", "event_type"), sums("value"), _one_filter("event_type NOT IN ('click', 'view')")))
def cube_blist1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(events(spark, sf_dir), ["day", "event_type"], [VALUE], [Filter("event_type", "BList", ("click", "view"))])


_PAIRS = ("O\tA", "O\tN", "F\tR")
_IN_PAIRS = "(l_linestatus || chr(9) || l_returnflag) IN (" + ", ".join(f"'{p.split(chr(9))[0]}' || chr(9) || '{p.split(chr(9))[1]}'" for p in _PAIRS) + ")"


def _two_column(condition: str) -> Sets:
    return [((), None), (("l_linenumber",), None), (("l_returnflag",), condition), (("l_linenumber", "l_returnflag"), condition)]


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), _two_column(_IN_PAIRS)))
def cube_wlist2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Filter("l_returnflag", "WList", _PAIRS, related="l_linestatus")])


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), _two_column(f"NOT {_IN_PAIRS}")))
def cube_blist2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Filter("l_returnflag", "BList", _PAIRS, related="l_linestatus")])


_CUSTOMER = f"SELECT n_name AS nation, c_mktsegment AS segment, {cents_sql('c_acctbal')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey"
_LISTED = "nation IN (SELECT n_name FROM nation WHERE n_regionkey = 1)"
_NATION_SETS: Sets = [((), None), (("segment",), None), (("nation",), _LISTED), (("nation", "segment"), _LISTED)]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), cents("c_acctbal").alias("balance"))


def _nation_list(spark: SparkSession, sf_dir: str, short: int) -> dict:
    path = fresh_folder(spark, "list")
    table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name").write.text(path)
    return load_lists(spark, (ConfigSource("nations", "HDFS", path=path),), datetime(2024, 1, 1), short=short)


@registered(lattice_sql(_CUSTOMER, ("nation", "segment"), sums("balance"), _NATION_SETS))
def cube_filter_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter whose list is a configured file, short enough for the plan."""
    return cube(_customers(spark, sf_dir), ["nation", "segment"], [Target("balance", "SUM")], [Filter("nation", "WList", config="nations")], _nation_list(spark, sf_dir, 100))


@registered(lattice_sql(_CUSTOMER, ("nation", "segment"), sums("balance"), _NATION_SETS))
def cube_filter_config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same list, joined as a table as a long one is."""
    return cube(_customers(spark, sf_dir), ["nation", "segment"], [Target("balance", "SUM")], [Filter("nation", "WList", config="nations")], _nation_list(spark, sf_dir, 1))


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), [((), None), (("l_linenumber", "l_linestatus"), None), (("l_returnflag",), "l_returnflag NOT IN ('N')"), (_THREE, "l_returnflag NOT IN ('N')")]))
def cube_filter_plus_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter beside a bound pair."""
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Bind(("l_linenumber", "l_linestatus")), Filter("l_returnflag", "BList", ("N",))])


@registered(lattice_sql(_LINE, _THREE, sums("quantity"), [((), None), (("l_linenumber",), None)]))
def cube_bind_then_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignoring a leader ignores what is bound to it."""
    return cube(lines(spark, sf_dir), _THREE, [QUANTITY], [Bind(("l_linestatus", "l_returnflag")), Ignore(("l_linestatus",))])


_COLLIDING = "SELECT CASE WHEN event_type = 'click' THEN 'ALL' ELSE event_type END AS event_type, day, value FROM (" + _EVENT + ")"


@registered("SELECT day, event_type, CAST(SUM(value) AS BIGINT) AS value FROM (" + lattice_sql(_COLLIDING, ("day", "event_type"), sums("value"), subsets(("day", "event_type"))) + ") GROUP BY day, event_type")
def all_literal_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value ALL in the data and the roll-up are one row."""
    df = events(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "click", "ALL").otherwise(F.col("event_type")))
    return cube(df, ["day", "event_type"], [VALUE])


@registered(lattice_sql("SELECT CASE WHEN event_type = 'view' THEN 'EMPTY' ELSE event_type END AS event_type, day, value FROM (" + _EVENT + ")", ("day", "event_type"), sums("value"), subsets(("day", "event_type"))))
def null_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL dimension is the value EMPTY."""
    return cube(events(spark, sf_dir).withColumn("event_type", F.nullif("event_type", F.lit("view"))), ["day", "event_type"], [VALUE])


# -- metrics -----------------------------------------------------------------------


@registered(lattice_sql("SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_custkey FROM customer", ("c_mktsegment", "c_nationkey"), "MAX(c_acctbal) AS high, MIN(c_acctbal) AS low, MAX(c_custkey) AS last, CAST(SUM(c_custkey) AS BIGINT) AS keys", subsets(("c_mktsegment", "c_nationkey"))))
def metric_sum_max_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return cube(df, ["c_mktsegment", "c_nationkey"], [Target("high", "MAX", value="c_acctbal"), Target("low", "MIN", value="c_acctbal"), Target("last", "MAX", value="c_custkey"), Target("keys", "SUM", value="c_custkey")])


@registered("SELECT * REPLACE (round(discount, 6) AS discount, round(quantity, 6) AS quantity) FROM (" + lattice_sql("SELECT l_returnflag, l_linestatus, CAST(round(l_discount * 100) AS BIGINT) AS d, l_quantity FROM lineitem", ("l_linestatus", "l_returnflag"), "CAST(SUM(d) AS DOUBLE) / COUNT(d) AS discount, CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) / COUNT(l_quantity) AS quantity", subsets(("l_linestatus", "l_returnflag"))) + ")")
def metric_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = cube(df, ["l_linestatus", "l_returnflag"], [Target("discount", "AVG", value="cast(round(l_discount * 100) as bigint)"), Target("quantity", "AVG", value="cast(l_quantity as bigint)")])
    return out.withColumns({c: F.round(c, 6) for c in ("discount", "quantity")})


def _dist_sql(base: str, dims: Sequence[str], sets: Sets, key: str, top: int = 0, prefix: str = "", by_key: bool = False) -> str:
    """Counts of ``key`` in each group as JSON text: the largest first, or by key."""
    counted = []
    for rolled, where in sets:
        shown = ", ".join(f"'ALL' AS {d}" if d in rolled else d for d in dims)
        kept = ", ".join([*(d for d in dims if d not in rolled), "k"])
        counted.append(f"SELECT {shown}, k, COUNT(*) AS n FROM (SELECT *, {key} AS k FROM base) WHERE k IS NOT NULL" + (f" AND {where}" if where else "") + f" GROUP BY {kept}")
    names = ", ".join(dims)
    order = "CAST(k AS INTEGER)" if by_key else "n DESC, k"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY {order}) AS r FROM (" + " UNION ALL ".join(counted) + ")"
    return f"WITH base AS ({base}), ranked AS ({ranked}) SELECT {names}, '{prefix}{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY r) || '}}' AS dist FROM ranked" + (f" WHERE r <= {top}" if top else "") + f" GROUP BY {names}"


@registered(_dist_sql(_EVENT, ("day",), subsets(("day",)), "event_type", 2))
def metric_valuedist_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(events(spark, sf_dir), ["day"], [Target("dist", "VALUEDIST", "2", "event_type")])


@registered(_dist_sql(_EVENT, ("day",), subsets(("day",)), "event_type"))
def metric_valuedist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(events(spark, sf_dir), ["day"], [Target("dist", "VALUEDIST", "0", "event_type")])


@registered(_dist_sql("SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem", ("l_linestatus", "l_returnflag"), subsets(("l_linestatus", "l_returnflag")), "CASE WHEN l_quantity < 0 THEN '0' WHEN l_quantity > 40 THEN '5' ELSE CAST(CAST(trunc(l_quantity / 10) AS INTEGER) + 1 AS VARCHAR) END", prefix="min:0.0,interval:10.0,max:40.0,", by_key=True))
def metric_rangedist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"], [Target("dist", "RANGEDIST", "0~10~40", "l_quantity")])


_BALANCE = "CASE WHEN c_acctbal < -500 THEN '0' WHEN c_acctbal > 5000 THEN '6' ELSE CAST(CAST(trunc(c_acctbal / 1000) AS INTEGER) + 1 AS VARCHAR) END"


@registered(_dist_sql("SELECT c_mktsegment, c_acctbal FROM customer", ("c_mktsegment",), subsets(("c_mktsegment",)), _BALANCE, prefix="min:-500.0,interval:1000.0,max:5000.0,", by_key=True))
def metric_rangedist_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values below the least, above the most and negative ones between: steps count from zero."""
    return cube(table(spark, sf_dir, "customer"), ["c_mktsegment"], [Target("dist", "RANGEDIST", "-500~1000~5000", "c_acctbal")])


@registered(lattice_sql(_EVENT, ("day", "event_type"), "CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users", subsets(("day", "event_type"))))
def uv_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(events(spark, sf_dir), ["day", "event_type"], [Target("users", "UVBITMAP", value="user_id")])


@registered(lattice_sql("SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey FROM lineitem", ("l_linestatus", "l_returnflag"), "CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS orders, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS parts", subsets(("l_linestatus", "l_returnflag"))))
def uv_bitmap_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts over ids in many bitmap blocks."""
    return cube(table(spark, sf_dir, "lineitem"), ["l_linestatus", "l_returnflag"], [Target("orders", "UVBITMAP", value="l_orderkey"), Target("parts", "UVBITMAP", value="l_partkey")])


def _within_bound(spark: SparkSession, sf_dir: str, kind: str, lg: int) -> DataFrame:
    """Whether each estimate lies within three standard errors of the exact count."""
    df = table(spark, sf_dir, "lineitem")
    dims = ["l_linestatus", "l_returnflag"]
    both = cube(df, dims, [Target("estimate", kind, value="l_orderkey"), Target("exact", "UVBITMAP", value="l_orderkey")])
    off = F.abs(F.col("estimate") - F.col("exact"))
    return both.select(*dims, F.col("exact").alias("orders"), (off <= F.col("exact") * (3 * 1.04 / 2 ** (lg / 2))).cast("int").alias("within"))


_BOUND_SQL = lattice_sql("SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem", ("l_linestatus", "l_returnflag"), "CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS orders, 1 AS within", subsets(("l_linestatus", "l_returnflag")))


@registered(_BOUND_SQL)
def uv_hll_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within_bound(spark, sf_dir, "UV_HYPERLOGLOG", 13)


@registered(_BOUND_SQL)
def uv_hllpp_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _within_bound(spark, sf_dir, "UV_HYPERLOGLOGPLUS", 14)


@registered(lattice_sql(f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_type = 'purchase' THEN {cents_sql('value')} END AS spent FROM events", ("day", "event_type"), "CAST(SUM(spent) AS BIGINT) AS spent, CAST(MAX(spent) AS BIGINT) AS most, CAST(COUNT(*) AS BIGINT) AS n", subsets(("day", "event_type"))))
def sparse_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that most rows lack is NULL where no row of a group has it."""
    df = events(spark, sf_dir).withColumn("spent", F.when(F.col("event_type") == "purchase", F.col("value")))
    return cube(df, ["day", "event_type"], [Target("spent", "SUM"), Target("most", "MAX", value="spent"), Target("n", "SUM", value="1")])


# -- periods -----------------------------------------------------------------------

_EVENT_TARGETS = (VALUE, Target("mean", "AVG", value="value"), Target("most", "MAX", value="value"), Target("users", "UVBITMAP", value="user_id"), Target("dist", "VALUEDIST", "1", "user_id % 3"))
_JANUARY = datetime(2024, 1, 1)


def rolled_up(rows: DataFrame, dims: list[str], targets: Sequence[Target], ts: Column, fine: Column, coarse: Callable[[Column], Column]) -> DataFrame:
    """States of fine periods, then merged by coarse period without reading the rows again."""
    states = cube_states(projected(rows.withColumn("period", fine), dims, targets, ["period"]), dims, targets, extra=["period"])
    states.rows = states.rows.withColumn("period", coarse(F.col("period")))
    return finalize(merged(states))


def _rollup_sql(period: str) -> str:
    base = f"SELECT event_type, {period} AS period, user_id, {cents_sql('value')} AS value FROM events"
    metric = "CAST(SUM(value) AS BIGINT) AS value, round(CAST(SUM(value) AS DOUBLE) / COUNT(value), 6) AS mean, MAX(value) AS most, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users"
    pick = "SELECT period, event_type, '{\"' || k || '\":' || n || '}' AS dist FROM (SELECT *, row_number() OVER (PARTITION BY period, event_type ORDER BY n DESC, k) AS r FROM (SELECT period, {e} AS event_type, CAST(user_id % 3 AS VARCHAR) AS k, COUNT(*) AS n FROM base GROUP BY ALL)) WHERE r = 1"
    dist = " UNION ALL ".join(pick.replace("{e}", e) for e in ("event_type", "'ALL'"))
    flat = " UNION ALL ".join(f"SELECT period, {e} AS event_type, {metric} FROM base GROUP BY ALL" for e in ("event_type", "'ALL'"))
    return f"WITH base AS ({base}), flat AS ({flat}), dist AS ({dist}) SELECT flat.*, dist.dist FROM flat JOIN dist USING (period, event_type)"


def _event_rollup(fine: str, coarse: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rolled_up(events(spark, sf_dir), ["event_type"], _EVENT_TARGETS, F.col("ts"), F.date_trunc(fine, F.col("ts")), coarse)
        return out.withColumn("mean", F.round("mean", 6))

    return run


def _text_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _since(days: int) -> Callable[[Column], Column]:
    """The start of the period of so many days, counted from the first of January 2024."""

    def start(c: Column) -> Column:
        first = F.lit("2024-01-01").cast("date")
        return _text_date(F.date_add(first, (F.floor(F.datediff(c, first) / days) * days).cast("int")))

    return start


def _since_sql(days: int) -> str:
    return f"CAST(CAST('2024-01-01' AS DATE) + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / {days}) * {days} AS INTEGER) AS VARCHAR)"


for _name, _fine, _coarse, _sql in (
    ("rollup_hour_day", "hour", _text_date, "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    ("rollup_day_week", "day", _since(7), _since_sql(7)),
    ("rollup_day_30d", "day", _since(30), _since_sql(30)),
    ("rollup_day_month", "day", lambda c: F.date_format(c, "yyyy-MM"), "strftime(ts, '%Y-%m')"),
):
    _query = _event_rollup(_fine, _coarse)
    _query.__name__ = _name
    registered(_rollup_sql(_sql))(_query)


def _order_rollup(coarse: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), cents("o_totalprice").alias("total"), "o_custkey")
        targets = [Target("total", "SUM"), Target("least", "MIN", value="total"), Target("customers", "UVBITMAP", value="o_custkey")]
        return rolled_up(df, ["priority", "status"], targets, F.col("o_orderdate"), F.date_trunc("month", F.col("o_orderdate")), coarse)

    return run


def _order_sql(period: str) -> str:
    base = f"SELECT {period} AS period, o_orderstatus AS status, o_orderpriority AS priority, {cents_sql('o_totalprice')} AS total, o_custkey FROM orders"
    return lattice_sql(base, ("period", "priority", "status"), "CAST(SUM(total) AS BIGINT) AS total, MIN(total) AS least, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS customers", subsets(("priority", "status")))


for _name, _coarse, _sql in (
    ("rollup_month_quarter", lambda c: F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")), "year(o_orderdate) || 'Q' || quarter(o_orderdate)"),
    ("rollup_month_half", lambda c: F.concat(F.year(c).cast("string"), F.lit("H"), F.ceil(F.month(c) / 6).cast("string")), "year(o_orderdate) || 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END"),
    ("rollup_month_year", lambda c: F.year(c).cast("string"), "CAST(year(o_orderdate) AS VARCHAR)"),
):
    _query = _order_rollup(_coarse)
    _query.__name__ = _name
    registered(_order_sql(_sql))(_query)


@registered("SELECT period, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS exact, 1 AS within FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, user_id FROM events) GROUP BY period")
def rollup_uv_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sketches merged by day stay within their error."""
    targets = [Target("estimate", "UV_HYPERLOGLOGPLUS", value="user_id"), Target("exact", "UVBITMAP", value="user_id")]
    out = rolled_up(events(spark, sf_dir).withColumn("one", F.lit("x")), ["one"], targets, F.col("ts"), F.date_trunc("hour", "ts"), _text_date).where("one = 'ALL'")
    return out.select("period", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.0244).cast("int").alias("within"))


@registered("SELECT 'Monthly' AS freq, strftime(d, '%Y-%m-%dT%H:%MZ') AS start FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-29', INTERVAL 1 DAY)) AS d) UNION ALL SELECT 'Daily', strftime(d, '%Y-%m-%dT%H:%MZ') FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-01 23:00', INTERVAL 1 HOUR)) AS d) UNION ALL SELECT 'Yearly', strftime(d, '%Y-%m-%dT%H:%MZ') FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2025-01-01', INTERVAL 1 MONTH)) AS d)")
def freq_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = datetime(2024, 2, 1)
    rows = [(f.value, format_period(s)) for f in (Frequency.Monthly, Frequency.Daily, Frequency.Yearly) for s in f.children(start)]
    return spark.createDataFrame(rows, "freq string, start string")


@registered("SELECT 'log/2024-01-01/' || lpad(CAST(h AS VARCHAR), 2, '0') AS path FROM (SELECT unnest(generate_series(0, 23)) AS h) UNION ALL SELECT 'days/2024/01/01'")
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = expand(["log/%Y-%M-%D/%H", "days/%Y/%M/%D"], _JANUARY, _JANUARY + timedelta(days=1))
    return spark.createDataFrame([(p,) for p in paths], "path string")


# -- transforms and access ---------------------------------------------------------


@registered(lattice_sql("SELECT lang, source, unnest(string_split(lower(text), ' ')) AS word FROM documents", ("lang", "source"), "CAST(COUNT(*) AS BIGINT) AS words, CAST(MAX(length(word)) AS BIGINT) AS longest", subsets(("lang", "source"))))
def transform_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record gives many rows."""
    df = table(spark, sf_dir, "documents").select("lang", "source", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return cube(df, ["lang", "source"], [Target("words", "SUM", value="1"), Target("longest", "MAX", value="length(word)")])


@registered(lattice_sql(f"SELECT * FROM ({_EVENT}) WHERE value > 5000 AND event_type <> 'view'", ("day", "event_type"), sums("value"), subsets(("day", "event_type"))))
def transform_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record gives no row."""
    return cube(events(spark, sf_dir).where((F.col("value") > 5000) & (F.col("event_type") != "view")), ["day", "event_type"], [VALUE])


@registered(lattice_sql("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", ("event_type",), "CAST(SUM(k) AS BIGINT) AS k, MAX(k) AS most, CAST(COUNT(*) - COUNT(k) AS BIGINT) AS missing", subsets(("event_type",))))
def json_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_type", A.get_long(A.json_field("props", "k")).alias("k"))
    return cube(df, ["event_type"], [Target("k", "SUM"), Target("most", "MAX", value="k"), Target("missing", "SUM", value="case when k is null then 1 else 0 end")])


@registered("SELECT s_suppkey, COALESCE(TRY_CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN CAST(s_nationkey AS VARCHAR) END AS BIGINT), -1) AS a_long, COALESCE(TRY_CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_acctbal AS VARCHAR) END AS DOUBLE), 0.5) AS a_double, CASE s_suppkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS a_boolean, CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE s_name END AS a_string, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS an_int FROM supplier")
def default_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed access with defaults: text that can't be parsed, missing and empty values."""
    k = F.col("s_suppkey")
    mixed = F.when(k % 3 == 0, F.col("s_name")).when(k % 3 == 1, F.col("s_nationkey").cast("string"))
    number = F.when(k % 2 == 0, F.col("s_name")).otherwise(F.col("s_acctbal").cast("string"))
    flag = F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "yes").when(k % 4 == 2, "false")
    named = F.when(k % 5 == 0, "").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", A.try_long(mixed, -1).alias("a_long"), A.try_double(number, 0.5).alias("a_double"), A.get_boolean(flag, True).alias("a_boolean"), A.get_string(named, "none", True).alias("a_string"), A.get_int(A.is_empty(named), 0).alias("an_int"))


@registered(lattice_sql("SELECT CAST(label AS VARCHAR) AS label, round(embedding[1] * 1000) AS first, len(embedding) AS width, embedding[1000] AS beyond FROM embeddings", ("label",), "CAST(SUM(CAST(first AS BIGINT)) AS BIGINT) AS first, CAST(MAX(width) AS BIGINT) AS width, CAST(COUNT(beyond) AS BIGINT) AS beyond", subsets(("label",))))
def array_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("label", F.round(A.element("embedding", 0) * 1000).cast("bigint").alias("first"), F.size(A.get_array("embedding")).alias("width"), A.element("embedding", 999).isNotNull().cast("int").alias("beyond"))
    return cube(df, ["label"], [Target("first", "SUM"), Target("width", "MAX"), Target("beyond", "SUM")])


@registered("SELECT c_mktsegment, CAST(SUM(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS balance, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(c_nationkey) AS BIGINT) AS nations FROM customer GROUP BY 1")
def map_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of maps and of nested records."""
    df = table(spark, sf_dir, "customer").select("c_mktsegment", F.create_map(F.lit("balance"), F.round("c_acctbal").cast("bigint"), F.lit("one"), F.lit(1).cast("bigint")).alias("m"), F.struct(F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("r"))
    df = df.select("c_mktsegment", A.get_map("m", "balance").alias("balance"), A.get_map("m", "one").alias("n"), A.field("r", "nation", "key").alias("nations"))
    return cube(df, ["c_mktsegment"], [Target("balance", "SUM"), Target("n", "SUM"), Target("nations", "SUM")], [Ignore(("c_mktsegment",))])


@registered(lattice_sql("SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS status, o_custkey FROM orders", ("status", "year"), "CAST(SUM(o_custkey) AS BIGINT) AS keys", subsets(("status", "year"))))
def config_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report without a transform: dimensions and targets are SQL expressions."""
    spec = ReportSpec("orders", (Dimension("year", "year(o_orderdate)"), Dimension("status", "o_orderstatus")), (Target("keys", "SUM", value="o_custkey"),))
    spec.validate()
    return finalize(report_states(table(spark, sf_dir, "orders"), spec))


_LONG_WORD = re.compile(r"[^ \n]{7,}")


def _word_rows(record: dict):
    """A row for each word longer than six letters of a record's whole text."""
    for word in _LONG_WORD.finditer(record["text"] or ""):
        yield {"lang": record["lang"], "words": 1, "letters": len(word[0])}


@registered(lattice_sql("SELECT lang, word FROM (SELECT lang, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents) WHERE length(word) > 6", ("lang",), "CAST(COUNT(*) AS BIGINT) AS words, CAST(SUM(length(word)) AS BIGINT) AS letters", subsets(("lang",))))
def transform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-at-a-time parse function: none, one or many rows a record."""
    df = emit_rows(table(spark, sf_dir, "documents"), _word_rows, "lang string, words long, letters long", ["lang", "text"])
    return cube(df, ["lang"], [Target("words", "SUM"), Target("letters", "SUM")])


@registered(lattice_sql("SELECT CAST(o_orderkey % 3 AS VARCHAR) AS part, CAST(o_custkey AS INTEGER) AS k, CAST(trunc(CAST(o_totalprice AS FLOAT)) AS BIGINT) AS price FROM orders", ("part",), "CAST(SUM(k) AS BIGINT) AS keys, CAST(SUM(price) AS BIGINT) AS price, CAST(SUM(CASE WHEN k % 2 = 0 THEN -1 ELSE k END) AS BIGINT) AS odd", subsets(("part",))))
def int_float_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access as int and float, with a default for what is missing."""
    odd = F.when(F.col("o_custkey") % 2 != 0, F.col("o_custkey"))
    df = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("part"), A.get_int(F.col("o_custkey").cast("string")).alias("keys"), A.get_float("o_totalprice").cast("bigint").alias("price"), A.get_int(odd, -1).alias("odd"))
    return cube(df, ["part"], [Target("keys", "SUM"), Target("price", "SUM"), Target("odd", "SUM")])


# -- sources -----------------------------------------------------------------------

_SCAN_SQL = lattice_sql("SELECT c_mktsegment AS segment, c_custkey, c_nationkey FROM customer", ("segment",), "CAST(SUM(c_custkey) AS BIGINT) AS keys, MAX(c_nationkey)::BIGINT AS last", subsets(("segment",)))
_SCAN_TARGETS = [Target("keys", "SUM"), Target("last", "MAX")]


def _copy(spark: SparkSession, sf_dir: str, kind: str) -> str:
    path = fresh_folder(spark, kind)
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    if kind == "text":
        df.select(line).write.text(path)
    elif kind == "sequence":
        df.select(line.alias("line")).rdd.map(lambda r: (None, r["line"])).saveAsSequenceFile(path)
    else:
        getattr(df.write, kind)(path)
    return path


def _parsed(lines_: DataFrame) -> DataFrame:
    part = A.split_line(A.get_data())
    return lines_.select(A.get_string(part[1]).alias("segment"), A.get_long(part[0]).alias("keys"), A.get_long(part[2]).alias("last"))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_mktsegment").alias("segment"), A.get_long("c_custkey").alias("keys"), A.get_long("c_nationkey").alias("last"))


def _scan(kind: str, spec: Callable[[str], InputSpec], shape: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _copy(spark, sf_dir, kind)
        return cube(shape(read(spark, spec(path), [path])), ["segment"], _SCAN_TARGETS)

    return run


for _name, _kind, _spec, _shape in (
    ("text_scan", "text", lambda p: InputSpec((p,)), _parsed),
    ("json_scan", "json", lambda p: InputSpec((p,), "text", "json"), _named),
    ("parquet_scan", "parquet", lambda p: InputSpec((p,), "parquet", fields=("c_mktsegment", "c_custkey", "c_nationkey")), _named),
    ("orc_scan", "orc", lambda p: InputSpec((p,), "orc"), _named),
    ("sequence_scan", "sequence", lambda p: InputSpec((p,), "sequence"), _parsed),
):
    _query = _scan(_kind, _spec, _shape)
    _query.__name__ = _name
    registered(_SCAN_SQL)(_query)


@registered("SELECT c_mktsegment AS segment, CAST(SUM(2 * c_nationkey) AS BIGINT) AS twice FROM customer GROUP BY 1")
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named fields of nested records are all that is read."""
    path = fresh_folder(spark, "nested")
    table(spark, sf_dir, "customer").select(F.struct(F.col("c_mktsegment").alias("segment"), F.struct((F.col("c_nationkey") * 2).alias("twice"), F.col("c_name").alias("name")).alias("inner")).alias("r"), "c_acctbal").write.parquet(path)
    df = nested_columns(spark.read.parquet(path), ["r.segment", "r.inner.twice"])
    return df.groupBy(F.col("r.segment").alias("segment")).agg(F.sum("r.inner.twice").alias("twice"))


@registered(lattice_sql("SELECT r_name, r_regionkey FROM region UNION ALL SELECT r_name, r_regionkey FROM region", ("r_name",), "CAST(SUM(r_regionkey) AS BIGINT) AS keys, CAST(COUNT(*) AS BIGINT) AS n", subsets(("r_name",))))
def multi_path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same path twice is read twice."""
    path = f"{sf_dir}/region.parquet"
    df = read(spark, InputSpec((path, path), "parquet"), [path, path])
    return cube(df, ["r_name"], [Target("keys", "SUM", value="r_regionkey"), Target("n", "SUM", value="1")])


# -- runs --------------------------------------------------------------------------


_logs: dict[tuple[str, str], str] = {}


def _log(spark: SparkSession, sf_dir: str) -> str:
    """All events in hourly directories, as a log arrives; written once in a session."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place in _logs and matching(spark, [f"{_logs[place]}/_SUCCESS"])[f"{_logs[place]}/_SUCCESS"]:
        return _logs[place]
    root = _logs[place] = fresh_folder(spark, "log")
    every = table(spark, sf_dir, "events").withColumn("d", F.date_format("ts", "yyyy-MM-dd")).withColumn("h", F.date_format("ts", "HH"))
    every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "d", "h").write.partitionBy("d", "h").parquet(root)
    return root


def _hours(spark: SparkSession, root: str) -> list[datetime]:
    """The hours of the log."""
    found = matching(spark, [f"{root}/d=*/h=*"])
    return sorted(datetime.strptime("/".join(p.split("/")[-2:]), "d=%Y-%m-%d/h=%H") for hits in found.values() for p in hits)


def _days(hours: Sequence[datetime]) -> list[datetime]:
    return sorted({h.replace(hour=0) for h in hours})


def _log_spec(name: str, root: str, dims: Sequence[str], targets: Sequence[Target], min_freq: Frequency) -> ReportSpec:
    return ReportSpec(name, tuple(Dimension(d) for d in dims), tuple(targets), InputSpec((f"{root}/d=%Y-%M-%D/h=%H",), "parquet", check="part"), min_freq=min_freq, transform=lambda df, _: df.withColumn("value", cents("value")).withColumn("visitor", F.col("user_id") % 10), across_periods=True)


def _day_of(df: DataFrame) -> DataFrame:
    """The period's day in ``day`` instead of its name."""
    return df.withColumn("day", F.substring(PERIOD, 1, 10)).drop(PERIOD)


_LOG = f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(user_id % 10 AS VARCHAR) AS visitor, user_id, {cents_sql('value')} AS value FROM events"


def _each_day(dim: str, metrics: str) -> str:
    return lattice_sql(_LOG, ("day", dim), metrics, subsets((dim,)))


@registered(f"SELECT 'by_type' AS report, day, event_type AS dim, value FROM ({_each_day('event_type', sums('value'))}) UNION ALL SELECT 'by_visitor', day, visitor, value FROM ({_each_day('visitor', sums('value'))})")
def shared_scan_multi_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports over one scan of every day's log, stored and read back."""
    root = _log(spark, sf_dir)
    days = _days(_hours(spark, root))
    specs = [_log_spec("by_type", root, ["event_type"], [VALUE], Frequency.Daily), _log_spec("by_visitor", root, ["visitor"], [VALUE], Frequency.Daily)]
    engine = Engine(spark, fresh_folder(spark, "store"))
    assert len(engine.plan(specs, Frequency.Daily, days).units) == len(days)
    engine.run(specs, Frequency.Daily, days)
    parts = [_day_of(engine.result(s, Frequency.Daily, days)).select(F.lit(s.name).alias("report"), "day", F.col(s.dims[0]).alias("dim"), "value") for s in specs]
    return parts[0].unionByName(parts[1])


@registered(_each_day("event_type", sums("value") + ", CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users"))
def run_hourly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours from the log in one call, all days from the hours' states; run twice, which replaces them."""
    root = _log(spark, sf_dir)
    spec = _log_spec("events", root, ["event_type"], [VALUE, Target("users", "UVBITMAP", value="user_id")], Frequency.Hourly)
    engine, hours = Engine(spark, fresh_folder(spark, "store")), _hours(spark, root)
    engine.run([spec], Frequency.Hourly, hours)
    for force in (False, True):
        engine.run([spec], Frequency.Daily, _days(hours), force)
    return _day_of(engine.result(spec, Frequency.Daily, _days(hours)))


_GRAINS = (
    ("Daily", "CAST(ts AS DATE)"), ("Weekly", _since_sql(7)), ("Thirtydays", _since_sql(30)), ("Monthly", "date_trunc('month', ts)"), ("Quarterly", "date_trunc('quarter', ts)"),
    ("HalfYearly", "make_date(year(ts), CASE WHEN month(ts) <= 6 THEN 1 ELSE 7 END, 1)"), ("Yearly", "date_trunc('year', ts)"),
)
_GRAINS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS freq, CAST(CAST({p} AS DATE) AS VARCHAR) AS day, event_type, user_id, {cents_sql('value')} AS value FROM events" for f, p in _GRAINS)


@registered(lattice_sql(_GRAINS_SQL, ("freq", "day", "event_type"), sums("value") + ", CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users", subsets(("event_type",))))
def run_every_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the log; weeks, thirty days and months from days' states; quarters, half years and years from months'."""
    root = _log(spark, sf_dir)
    spec = _log_spec("events", root, ["event_type"], [VALUE, Target("users", "UVBITMAP", value="user_id")], Frequency.Daily)
    engine, days = Engine(spark, fresh_folder(spark, "store")), _days(_hours(spark, root))
    end, parts = days[-1] + timedelta(days=1), []
    for freq in (Frequency(name) for name, _ in _GRAINS):
        starts = [s for s in freq.starts(_JANUARY, end) if any(s <= d < freq.end(s) for d in days)]
        engine.run([spec], freq, starts)
        parts.append(_day_of(engine.result(spec, freq, starts)).withColumn("freq", F.lit(freq.value)))
    return reduce(DataFrame.unionByName, parts)


@registered(_each_day("event_type", sums("value")))
def state_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods written twice are there once."""
    root = _log(spark, sf_dir)
    spec = _log_spec("twice", root, ["event_type"], [VALUE], Frequency.Daily)
    engine, days = Engine(spark, fresh_folder(spark, "store")), _days(_hours(spark, root))
    engine.run([spec], Frequency.Daily, days)
    engine.run([spec], Frequency.Daily, days, force=True)
    return _day_of(engine.result(spec, Frequency.Daily, days))


_XML = """<ReportConfig ver="0001">
  <input><path>%(root)s/d=%%Y-%%M-%%D/h=%%H</path><file_type>parquet</file_type><check>part</check></input>
  <output><type>mysql</type><param dbName="test"/></output>
  <report>
    <dimension><event_type/><visitor/></dimension>
    <target><value type="SUM"/><most type="MAX" value="value"/></target>
    <minFreq>Daily</minFreq><priority>10.3</priority>
    <cuboid><filter dimension="event_type.visitor" type="WList" source="list" split=";">click\t1;view\t2</filter></cuboid>
  </report>
</ReportConfig>"""


@registered(lattice_sql(_LOG, ("day", "event_type", "visitor"), "CAST(SUM(value) AS BIGINT) AS value, MAX(value) AS most", [((), None), (("visitor",), "event_type || '/' || visitor IN ('click/1', 'view/2')")]))
def report_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as an XML definition: input, two-column filter, run and result."""
    root = _log(spark, sf_dir)
    spec = from_xml(_XML % {"root": root}, "xml", lambda df, _: df.withColumn("value", cents("value")).withColumn("visitor", F.col("user_id") % 10))
    engine, days = Engine(spark, fresh_folder(spark, "store")), _days(_hours(spark, root))
    engine.run([spec], Frequency.Daily, days)
    return _day_of(engine.result(spec, Frequency.Daily, days))


@registered(lattice_sql(_LOG, ("event_type",), sums("value"), subsets(("event_type",))))
def glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input path with wildcards, for a month of directories at once."""
    spec = InputSpec((f"{_log(spark, sf_dir)}/d=%Y-*/h=[0-9]*",), "parquet")
    paths = resolve(spark, spec, _JANUARY, Frequency.Monthly.end(_JANUARY))
    return cube(read(spark, spec, paths).withColumn("value", cents("value")), ["event_type"], [VALUE])


@registered("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(COUNT(DISTINCT hour(ts)) AS BIGINT) AS hours, CAST(COUNT(DISTINCT hour(ts)) = 24 AS INTEGER) AS complete FROM events GROUP BY 1")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's hours that are there, and whether the check ``all`` lets the day pass."""
    root = _log(spark, sf_dir)
    spec, rows = InputSpec((f"{root}/d=%Y-%M-%D/h=%H",), "parquet"), []
    for day in _days(_hours(spark, root)):
        end = Frequency.Daily.end(day)
        try:
            resolve(spark, spec, day, end)
            complete = 1
        except MissingInput:
            complete = 0
        rows.append((f"{day:%Y-%m-%d}", len(resolve(spark, spec, day, end, check="part")), complete))
    return spark.createDataFrame(rows, "day string, hours long, complete int")


@registered(lattice_sql("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour FROM events", ("day", "hour"), "CAST(COUNT(*) AS BIGINT) AS records", subsets(("day", "hour"))))
def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and hour of each record from the path of its file."""
    root = _log(spark, sf_dir)
    paths = resolve(spark, InputSpec((f"{root}/d=*/h=*",)), _JANUARY, _JANUARY)
    df = with_file(read(spark, InputSpec(tuple(paths), "parquet"), paths)).where(F.col("file_name").like("part-%.parquet"))
    part = lambda name: F.regexp_extract("file_path", f"/{name}=([^/]+)/", 1).alias({"d": "day", "h": "hour"}[name])
    return cube(df.select(part("d"), part("h")), ["day", "hour"], [Target("records", "SUM", value="1")])


@registered(lattice_sql("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS period, user_id, " + cents_sql("value") + " AS value FROM events", ("period", "event_type"), "CAST(SUM(value) AS BIGINT) AS value, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users", subsets(("event_type",))))
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily states from a stream of files, merged over its batches."""
    root = fresh_folder(spark, "stream")
    source = table(spark, sf_dir, "events")
    source.repartition(3, "event_id").write.parquet(f"{root}/in")
    records = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", "1").parquet(f"{root}/in")
    spec = ReportSpec("stream", (Dimension("event_type"),), (Target("value", "SUM", value="cast(round(value * 100) as bigint)"), Target("users", "UVBITMAP", value="user_id")), min_freq=Frequency.Daily)
    start_stream(records, spec, F.col("ts"), f"{root}/states", f"{root}/checkpoint").awaitTermination()
    out = finalize(read_stream_states(spark, spec, f"{root}/states"))
    return out.select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "event_type", "value", "users")


# -- export ------------------------------------------------------------------------

_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@contextmanager
def _database(spark: SparkSession) -> Iterator[JdbcSink]:
    """A sink into an embedded database on the driver's own disk, which goes with the block."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="latticework-derby-"))
    try:
        yield JdbcSink(spark, f"jdbc:derby:{folder}/db;create=true", driver=_DERBY)
    finally:
        with suppress(Py4JJavaError):  # by which Derby says that it has shut the database
            JdbcSink(spark, f"jdbc:derby:{folder}/db;shutdown=true", driver=_DERBY).execute()
        shutil.rmtree(folder, ignore_errors=True)


_EXPORT = lattice_sql(_EVENT, ("day", "event_type"), sums("value"), subsets(("day", "event_type")))


@registered(f"SELECT day AS area, event_type, CAST(value AS VARCHAR) AS total, '0' AS nothing, '1704067200' AS \"timestamp\" FROM ({_EXPORT})")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's columns by alias and name, its defaults and the period as epoch seconds."""
    df = cube(events(spark, sf_dir), ["day", "event_type"], [VALUE])
    return project(df, ["area", "event_type", "total", "nothing", "timestamp"], _JANUARY, {"area": "day", "total": "value"})


@registered("SELECT p_name, p_brand, CASE WHEN p_brand IS NULL THEN 'p_brand: no value' || CASE WHEN octet_length(encode(p_name)) > 12 THEN '; p_name: longer than 12 bytes' ELSE '' END WHEN octet_length(encode(p_name)) > 12 THEN 'p_name: longer than 12 bytes' END AS errorinfo FROM (SELECT p_name, CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS p_brand FROM part) WHERE p_brand IS NULL OR octet_length(encode(p_name)) > 12")
def export_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a table can't hold, with the reason."""
    df = table(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("p_brand"), "p_name")
    return rejects(df, [TableColumn("p_brand", "varchar(10)", nullable=False), TableColumn("p_name", "varchar(12)")])[1]


@registered("""SELECT 'me' AS "user", 'Parts' AS modelname, 'check' AS type, '{' || CASE WHEN p_size > 40 THEN '' ELSE '"p_brand":"' || p_brand || '",' END || '"p_name":"' || p_name || '"}' AS context,
CASE WHEN p_size > 40 THEN 'p_brand: no value' || CASE WHEN octet_length(encode(p_name)) > 12 THEN '; p_name: longer than 12 bytes' ELSE '' END ELSE 'p_name: longer than 12 bytes' END AS errorinfo, 1704067200 AS "timestamp" FROM part WHERE p_size > 40 OR octet_length(encode(p_name)) > 12""")
def reject_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the form of the exception table, written and read back."""
    with _database(spark) as sink:
        sink.execute('CREATE TABLE rejected ("user" VARCHAR(64), modelname VARCHAR(128), type VARCHAR(128), context CLOB, errorinfo CLOB, "timestamp" INTEGER)')
        sink.append(reject_rows(export_rejects(spark, sf_dir), "me", "Parts", _JANUARY), "rejected")
        return sink.select('SELECT "user", modelname AS "modelname", type AS "type", context AS "context", errorinfo AS "errorinfo", "timestamp" FROM rejected')


@registered(lattice_sql(f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS period, event_type, {cents_sql('value')} AS value FROM events", ("period", "event_type"), sums("value") + ", CAST(COUNT(*) AS BIGINT) AS events", subsets(("event_type",))))
def export_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour exported into one table, a day's hours a write and several writes at once, and again; the table read back."""
    root = _log(spark, sf_dir)
    spec = _log_spec("Events", root, ["event_type"], [VALUE, Target("events", "SUM", value="1")], Frequency.Hourly)
    engine, hours = Engine(spark, fresh_folder(spark, "store")), _hours(spark, root)
    engine.run([spec], Frequency.Hourly, hours)
    name = spec.table_name(Frequency.Hourly)

    def write(day: datetime) -> None:
        own = [h for h in hours if h.date() == day.date()]
        rows = engine.result(spec, Frequency.Hourly, own)
        shown = project(rows, columns, period_time(), {c.upper(): c for c in rows.columns})
        sink.replace_periods(shown, name, "TIMESTAMP", [str(int(h.replace(tzinfo=timezone.utc).timestamp())) for h in own])

    with _database(spark) as sink:
        sink.execute('CREATE TABLE EventsHourly (event_type VARCHAR(20), value BIGINT, events BIGINT, "TIMESTAMP" BIGINT)')
        columns = [c.name for c in sink.columns(name)]
        with ThreadPoolExecutor(4) as pool:
            for _ in range(2):
                list(pool.map(write, _days(hours)))
        return sink.select('SELECT "TIMESTAMP" AS "period", event_type AS "event_type", value AS "value", events AS "events" FROM EventsHourly')


@registered(f"SELECT * FROM ({_EXPORT}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, day) <= 3")
def export_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest rows of each group (the output's Top filter)."""
    df = cube(events(spark, sf_dir), ["day", "event_type"], [VALUE])
    spec = OutputSpec(top=(TopFilter("value", 3),))
    return top_rows(df, spec.top, ["event_type"])


@registered(lattice_sql(_EVENT, ("day", "event_type"), sums("value") + ", MAX(value) AS most, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users", subsets(("day", "event_type"))))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type: sums, maxima and exact distinct users of every roll-up."""
    return cube(events(spark, sf_dir), ["day", "event_type"], [VALUE, Target("most", "MAX", value="value"), Target("users", "UVBITMAP", value="user_id")])
