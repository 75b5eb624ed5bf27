"""Command line: ``python -m latticework run|export REPORT... PERIOD FREQUENCY``."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from latticework.engine import Engine, RunError
from latticework.plans.frequency import Frequency, parse_period
from latticework.plans.schedule import Work
from latticework.plans.spec import ReportSpec, from_xml
from latticework.sinks.export import JdbcSink, UnsupportedSink, export, parse_aliases, project, reject_rows, timestamp_value, top_rows


def load_report(folder: Path) -> tuple[ReportSpec, dict[str, dict[str, str]]]:
    """A report from its folder: ``report.def.xml``, ``parse.py`` with ``parse(df, context)``, and ``exportAliasName``."""
    transform = None
    script = folder / "parse.py"
    if script.exists():
        spec = importlib.util.spec_from_file_location(f"parse_{folder.name}", script)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        transform = module.parse
    aliases = folder / "exportAliasName"
    return from_xml(folder / "report.def.xml", folder.name, transform), parse_aliases(aliases.read_text().splitlines()) if aliases.exists() else {}


def exporter(spark: SparkSession, aliases: dict[str, dict[str, dict[str, str]]], url: str, options: dict[str, str], strict: bool, timestamp: str, user: str, rejected: str | None):
    """A function that replaces a report's period in its table and appends what the table can't hold to ``rejected``."""
    sink = JdbcSink(spark, url, **options)

    def run(work: Work, rows: DataFrame) -> None:
        name, kind = work.spec.table_name(work.freq), work.spec.output.type
        if kind not in ("mysql", "phoenix"):
            raise UnsupportedSink(f"{work.spec.name}: output {kind} has no sink")
        columns, named, rows = sink.columns(name), aliases.get(work.spec.name, {}).get(name), top_rows(rows, work.spec.output.top)
        if kind == "phoenix":  # rows are written by key, the period as text, blanks for what is missing
            shown = project(rows, [c.name for c in columns], work.start, named, " ", "Date", upper=True)
            sink.upsert(shown, name, [c.name for c in columns if not c.nullable], "phoenix" if "phoenix" in url else "merge")
            return
        good, bad = export(rows, columns, work.start, named, strict=strict, timestamp=timestamp)
        value = spark.range(1).select(timestamp_value(work.start, timestamp).alias("v")).first()["v"]
        column = next((c.name for c in columns if c.name.lower() == "timestamp"), "timestamp")
        sink.replace_period(good, name, column, f"'{value}'" if timestamp == "Date" else str(value))
        if rejected:
            sink.append(reject_rows(bad, user, name, work.start), rejected)

    return run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="latticework", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("run", "run what a period lacks, children included"), ("export", "export a stored period again")):
        c = commands.add_parser(name, help=what)
        c.add_argument("reports", help="folders of report definitions, separated by commas")
        c.add_argument("period", help="start of the period, such as 2024-01-31T00:00Z")
        c.add_argument("frequency", choices=[f.value for f in Frequency])
        c.add_argument("--store", required=True, help="folder of the state store")
        c.add_argument("--base-dir", help="folder of relative input paths")
        c.add_argument("--jdbc-url", default=os.environ.get("LATTICEWORK_JDBC_URL"), help="database to export to; user and password come from LATTICEWORK_JDBC_USER and LATTICEWORK_JDBC_PASSWORD")
        c.add_argument("--jdbc-driver", default=None)
        c.add_argument("--strict", action="store_true", help="fail on the first row that the table can't hold")
        c.add_argument("--timestamp", choices=("epoch", "Date"), default="epoch")
        c.add_argument("--rejected-table", default=None)
        if name == "run":
            c.add_argument("--force", action="store_true", help="run the period itself again")
            c.add_argument("--threads", type=int, default=4)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("latticework").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    loaded = [load_report(Path(r)) for r in args.reports.split(",")]
    specs, aliases = [s for s, _ in loaded], {s.name: a for s, a in loaded}
    freq, start = Frequency(args.frequency), parse_period(args.period)
    engine = Engine(spark, args.store, args.base_dir, threads=getattr(args, "threads", 1))
    write = None
    if args.jdbc_url:
        options = {k: v for k, v in (("driver", args.jdbc_driver), ("user", os.environ.get("LATTICEWORK_JDBC_USER")), ("password", os.environ.get("LATTICEWORK_JDBC_PASSWORD"))) if v}
        write = exporter(spark, aliases, args.jdbc_url, options, args.strict, args.timestamp, os.environ.get("USER", ""), args.rejected_table)
    try:
        if args.command == "run":
            for work in engine.run(specs, freq, start, args.force, write):
                print(f"done {work.spec.name} {work.freq.value} {args.period}")
        else:
            failed: dict[str, BaseException] = {}
            for spec in specs:
                try:
                    if write is None:
                        raise ValueError("export needs --jdbc-url")
                    write(Work(spec, freq, start), engine.result(spec, freq, start))
                except Exception as e:  # the others are exported all the same; the exit code tells
                    failed[spec.name] = e
            if failed:
                raise RunError(failed)
    except RunError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0
