"""Date-templated paths and the check of their completeness."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import SparkSession

from latticework.plans.frequency import Frequency
from latticework.plans.spec import InputSpec


class MissingInput(FileNotFoundError):
    """The input of a period isn't as complete as the report demands."""


def fill(template: str, moment: datetime, **more: str) -> str:
    """``%Y %M %D %H`` replaced by the moment's year, month, day and hour; ``more`` replaces other marks."""
    marks = {"%Y": f"{moment:%Y}", "%M": f"{moment:%m}", "%D": f"{moment:%d}", "%H": f"{moment:%H}"} | {f"%{k}": v for k, v in more.items()}
    for mark in sorted(marks, key=len, reverse=True):
        template = template.replace(mark, marks[mark])
    return template


def expand(templates: Sequence[str], start: datetime, end: datetime) -> list[str]:
    """A template with ``%H`` gives a path for each hour from start to end; one without gives that of the start alone."""
    out: list[str] = []
    for t in templates:
        moments = Frequency.Hourly.starts(start, end) if "%H" in t else [start]
        out += [fill(t, m) for m in moments]
    return list(dict.fromkeys(out))


_PLAIN = re.compile(r"[\w.=-]+")


def _children(spark: SparkSession, folder: str) -> dict[str, str] | None:
    """The whole paths of what a folder holds, by name, fetched as one text; None if a comma in a name makes it ambiguous."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(at))
    every = jvm.org.apache.commons.lang3.ArrayUtils.toString(paths)[1:-1].split(",") if len(paths) else []
    return {p.rpartition("/")[2]: p for p in every} if len(every) == len(paths) else None


def matching(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """For each path or glob what it matches, on whatever file system it names.

    Plain paths are looked up in one listing of their folder.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    listed: dict[str, dict[str, str] | None] = {}
    for p in paths:
        folder, _, name = p.rpartition("/")
        if folder and _PLAIN.fullmatch(name) and not set(folder) & set("*?[]{},\\"):
            if folder not in listed:
                listed[folder] = _children(spark, folder)
            if (there := listed[folder]) is not None:
                found[p] = [there[name]] if name in there else []
                continue
        at = jvm.org.apache.hadoop.fs.Path(p)
        status = at.getFileSystem(conf).globStatus(at)
        found[p] = [s.getPath().toString() for s in status or ()]
    return found


_STRICTNESS = ("no", "part", "all")


def strictest(checks: Sequence[str]) -> str:
    return max(checks, key=_STRICTNESS.index)


def resolve(spark: SparkSession, spec: InputSpec, start: datetime, end: datetime, base_dir: str | None = None, check: str | None = None) -> list[str]:
    """The existing paths of a period; raises unless the check holds.

    ``all``: every path matches; ``part`` and ``no``: at least one does, since a
    period without any input is an error in either case.
    """
    prefix = f"{base_dir.rstrip('/')}/" if base_dir else ""
    paths = [p if "://" in p or p.startswith("/") else prefix + p for p in expand(spec.paths, start, end)]
    found = matching(spark, paths)
    missing = [p for p, hits in found.items() if not hits]
    if len(missing) == len(paths):
        raise MissingInput(f"no input for {start:%Y-%m-%dT%H:%MZ}: {paths[:3]}")
    if missing and (check or spec.check) == "all":
        raise MissingInput(f"{len(missing)} of {len(paths)} inputs are missing: {missing[:3]}")
    return [h for hits in found.values() for h in hits]
