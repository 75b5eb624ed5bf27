"""Export of finished reports to tables: projection, checks, rejects and JDBC."""

from __future__ import annotations

import re
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.jdbc import BATCH, connected, read_rows, write_rows
from latticework.plans.spec import TopFilter


@dataclass(frozen=True)
class TableColumn:
    """A column of the target table, as its description says."""

    name: str
    type: str = "varchar(255)"
    nullable: bool = True
    default: str | None = None

    @property
    def max_bytes(self) -> int | None:
        kind = self.type.lower()
        if m := re.match(r"(?:var)?char\((\d+)\)", kind):
            return int(m[1])
        return {"tinytext": 255, "text": 65535}.get(kind)


def parse_aliases(lines: Sequence[str]) -> dict[str, dict[str, str]]:
    """``Table.column=field`` lines: for each table, its columns' fields."""
    out: dict[str, dict[str, str]] = {}
    for line in lines:
        left, _, field = line.strip().partition("=")
        table, _, column = left.partition(".")
        if table and column and field:
            out.setdefault(table.strip(), {})[column.strip()] = field.strip()
    return out


def timestamp_value(start: datetime | Column, kind: str = "epoch") -> Column:
    """The period start as epoch seconds, or ``yyyy-MM-dd HH:mm:ss`` for ``Date``; a column tells each row's own start."""
    if isinstance(start, Column):
        return F.date_format(start, "yyyy-MM-dd HH:mm:ss") if kind == "Date" else F.unix_timestamp(start)
    if kind == "Date":
        return F.lit(start.strftime("%Y-%m-%d %H:%M:%S"))
    return F.lit(int(start.replace(tzinfo=timezone.utc).timestamp()))


def project(df: DataFrame, columns: Sequence[str], start: datetime | Column, aliases: Mapping[str, str] | None = None, missing: str = "0", timestamp: str = "epoch", upper: bool = False) -> DataFrame:
    """The table's columns from the report's: by alias, else by name (in any case for ``upper``); the
    column ``timestamp`` is the period start; what the report lacks or has no value for is ``missing``."""
    aliases = aliases or {}
    fields = {(c.upper() if upper else c): c for c in df.columns}
    out = []
    for name in columns:
        field = aliases.get(name, name)
        if field.lower() == "timestamp" and field not in fields:
            out.append(timestamp_value(start, timestamp).cast("string").alias(name))
            continue
        said = fields.get(field.upper() if upper else field)
        value = F.col(f"`{said}`").cast("string") if said else F.lit(None).cast("string")
        if upper:
            value = F.nullif(value, F.lit(""))
        out.append(F.coalesce(value, F.lit(missing)).alias(name))
    return df.select(*out)


def rejects(df: DataFrame, table: Sequence[TableColumn]) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the table, rows that don't with ``errorinfo``)."""
    problems = []
    for c in table:
        if c.name not in df.columns:
            if not c.nullable and c.default is None:
                problems.append(F.lit(f"{c.name}: no value"))
            continue
        value = F.col(f"`{c.name}`")
        if not c.nullable and c.default is None:
            problems.append(F.when(value.isNull(), F.lit(f"{c.name}: no value")))
        if c.max_bytes is not None:
            problems.append(F.when(F.octet_length(value.cast("string")) > c.max_bytes, F.lit(f"{c.name}: longer than {c.max_bytes} bytes")))
    checked = df.withColumn("errorinfo", F.nullif(F.concat_ws("; ", *problems), F.lit("")) if problems else F.lit(None).cast("string"))
    return checked.where("errorinfo is null").drop("errorinfo"), checked.where("errorinfo is not null")


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many UTF-8 bytes."""
    cut = F.substring(c.cast("binary"), 1, most)
    # an incomplete last character becomes the replacement character, and goes
    text = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(text)


def reject_rows(bad: DataFrame, user: str, model: str, start: datetime, kind: str = "check") -> DataFrame:
    """Rejected rows in the form of the exception table."""
    context = F.to_json(F.struct(*(F.col(f"`{c}`") for c in bad.columns if c != "errorinfo")))
    return bad.select(
        truncate_bytes(F.lit(user), 64).alias("user"),
        truncate_bytes(F.lit(model), 128).alias("modelname"),
        truncate_bytes(F.lit(kind), 128).alias("type"),
        truncate_bytes(context, 65535).alias("context"),
        truncate_bytes(F.col("errorinfo"), 65535).alias("errorinfo"),
        timestamp_value(start).cast("int").alias("timestamp"),
    )


def top_rows(df: DataFrame, filters: Sequence[TopFilter], period: Sequence[str] = ()) -> DataFrame:
    """The rows with the largest keys, ``n`` for each filter and period."""
    for k, f in enumerate(filters):
        order = (F.col(f.key).desc_nulls_last(), *(c for c in df.columns if c != f.key))
        if not period:
            df = df.orderBy(*order).limit(f.n)
            continue
        order = Window.partitionBy(*period).orderBy(*order)
        df = df.withColumn(f"_top{k}", F.row_number().over(order)).where(F.col(f"_top{k}") <= f.n).drop(f"_top{k}")
    return df


class UnsupportedSink(RuntimeError):
    """A definition names an output that has no sink."""


class StrictInsertError(RuntimeError):
    """Rows were rejected while strict insertion was asked for."""


_changing: defaultdict[tuple[str, str], threading.Lock] = defaultdict(threading.Lock)


class JdbcSink:
    """Replaces a period in a table: staged rows, then delete and insert in one transaction.

    Each write has a stage of its own, made like the table and dropped at its end, so
    writes of several periods into one table run at once; only what changes the table
    itself, or makes and drops stages, is done one at a time for each database and table.
    The options are those of Spark's JDBC source (url, driver, user, password);
    they are never logged. An embedded database, which is the driver's own, gets its rows
    from the driver and is read by it.
    """

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def execute(self, *statements: str) -> None:
        """Runs statements in one transaction."""
        with connected(self.spark, self.url, self.options) as connection:
            try:
                connection.setAutoCommit(False)
                statement = connection.createStatement()
                for s in statements:
                    statement.executeUpdate(s)
                connection.commit()
            except Exception:
                connection.rollback()
                raise

    def columns(self, table: str) -> list[TableColumn]:
        """The table's description."""
        with connected(self.spark, self.url, self.options) as connection:
            found = connection.getMetaData().getColumns(None, None, table.upper() if "derby" in self.url else table, None)
            out = []
            while found.next():
                kind = found.getString("TYPE_NAME").lower()
                size = found.getInt("COLUMN_SIZE")
                out.append(TableColumn(found.getString("COLUMN_NAME"), f"{kind}({size})" if "char" in kind else kind, found.getInt("NULLABLE") != 0, found.getString("COLUMN_DEF")))
            return out

    def append(self, df: DataFrame, table: str, batch: int = BATCH) -> None:
        write_rows(df, self.url, table, self.options, batch)

    def _alone(self, table: str) -> threading.Lock:
        return _changing[self.url, table.lower()]

    def _create_like(self, table: str, stage: str) -> str:
        kind = self.url.split(":")[1].lower()
        if kind in ("mysql", "mariadb"):
            return f"CREATE TABLE {stage} LIKE {table}"
        return f"CREATE TABLE {stage} AS SELECT * FROM {table} " + ("WITH NO DATA" if kind == "derby" else "WHERE 1 = 0")

    @contextmanager
    def staged(self, df: DataFrame, table: str, batch: int = BATCH) -> Iterator[str]:
        """The name of a table that holds the rows until the end of the block."""
        stage = f"{table}_stage_{uuid.uuid4().hex[:12]}"
        with self._alone(table):
            self.execute(self._create_like(table, stage))
        try:
            self.append(df, stage, batch)
            yield stage
        finally:
            with self._alone(table):
                self.execute(f"DROP TABLE {stage}")

    def replace_period(self, df: DataFrame, table: str, timestamp_column: str, value: str, batch: int = BATCH) -> None:
        self.replace_periods(df, table, timestamp_column, [value], batch)

    def replace_periods(self, df: DataFrame, table: str, timestamp_column: str, values: Sequence[str], batch: int = BATCH) -> None:
        """Swaps the rows of these periods in one transaction, once all are staged: a failed write leaves the old rows."""
        names = ", ".join(df.columns)
        with self.staged(df, table, batch) as stage, self._alone(table):
            self.execute(f"DELETE FROM {table} WHERE {timestamp_column} IN ({', '.join(values)})", f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")

    def upsert(self, df: DataFrame, table: str, keys: Sequence[str], dialect: str = "merge", batch: int = BATCH) -> None:
        """Writes rows by key without deleting any: staged, then merged in one statement."""
        with self.staged(df, table, batch) as stage, self._alone(table):
            self.execute(upsert_statement(table, stage, df.columns, keys, dialect))

    def select(self, sql: str) -> DataFrame:
        """The rows of a statement."""
        return read_rows(self.spark, self.url, sql, self.options)

    def change(self, sql: str, *values: object) -> int:
        """Runs one statement with ``?`` marks bound to values, never pasted in; gives the rows changed."""
        with connected(self.spark, self.url, self.options) as connection:
            statement = connection.prepareStatement(sql)
            for i, v in enumerate(values, 1):
                statement.setObject(i, v)
            return statement.executeUpdate()

    def insert_row(self, table: str, row: Mapping[str, object]) -> int:
        return self.change(f"INSERT INTO {table} ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", *row.values())

    def update_rows(self, table: str, row: Mapping[str, object], where: Mapping[str, object]) -> int:
        return self.change(f"UPDATE {table} SET {', '.join(f'{c} = ?' for c in row)} WHERE {' AND '.join(f'{c} = ?' for c in where)}", *row.values(), *where.values())

    def delete_rows(self, table: str, where: Mapping[str, object]) -> int:
        return self.change(f"DELETE FROM {table} WHERE {' AND '.join(f'{c} = ?' for c in where)}", *where.values())


def upsert_statement(table: str, stage: str, columns: Sequence[str], keys: Sequence[str], dialect: str) -> str:
    """The statement that brings staged rows into a table by key."""
    names = ", ".join(columns)
    if dialect == "phoenix":
        return f"UPSERT INTO {table} ({names}) SELECT {names} FROM {stage}"
    if dialect == "mysql":
        changed = ", ".join(f"{c} = VALUES({c})" for c in columns if c not in keys)
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}" + (f" ON DUPLICATE KEY UPDATE {changed}" if changed else "")
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    changed = ", ".join(f"{c} = s.{c}" for c in columns if c not in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {changed}" if changed else ""
    return f"MERGE INTO {table} t USING {stage} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{c}' for c in columns)})"


def export(df: DataFrame, table: Sequence[TableColumn], start: datetime, aliases: Mapping[str, str] | None = None, missing: str = "0", strict: bool = False, timestamp: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """The (good, rejected) rows of a report for a table; strict insertion raises on the first rejected row."""
    shown = project(df, [c.name for c in table], start, aliases, missing, timestamp)
    good, bad = rejects(shown, table)
    if strict and (first := bad.select("errorinfo").first()):
        raise StrictInsertError(first["errorinfo"])
    return good, bad
