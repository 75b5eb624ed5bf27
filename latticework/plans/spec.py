"""Report definitions: frozen dataclasses, readable from XML or dictionaries, checked by ``validate``."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from latticework.plans.frequency import Frequency

METRIC_TYPES = ("SUM", "MAX", "MIN", "AVG", "VALUEDIST", "RANGEDIST", "UVBITMAP", "UV_HYPERLOGLOG", "UV_HYPERLOGLOGPLUS")
UNSUPPORTED_METRICS = ("PV", "UV", "UV_ACC", "PERCENTDIST")
FILE_TYPES = ("text", "avro", "sequence", "parquet", "orc")
DATA_TYPES = ("struct", "json")
CHECKS = ("no", "part", "all")
OUTPUTS = ("mysql", "phoenix", "redis", "mongodb")
_SEQUENCE_NAMES = {"seqfile": "sequence", "sequencefile": "sequence", "seq": "sequence"}


class SpecError(ValueError):
    """A report definition that can't be run."""


@dataclass(frozen=True)
class Dimension:
    name: str
    value: str | None = None  # SQL expression; None: the transform's column of this name


@dataclass(frozen=True)
class Target:
    name: str
    type: str
    param: str | None = None
    value: str | None = None  # SQL expression; None: the transform's column of this name


@dataclass(frozen=True)
class Ignore:
    """These dimensions are always grouped by."""

    dims: tuple[str, ...]


@dataclass(frozen=True)
class Bind:
    """These dimensions are rolled up together; the first leads."""

    dims: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    """Only rows whose value is (``WList``) or isn't (``BList``) listed join the roll-up of ``dim``.

    With ``related`` the list holds ``related<TAB>dim`` pairs.  ``config`` names a
    configured list instead of ``values``.
    """

    dim: str
    kind: str  # WList or BList
    values: tuple[str, ...] | None = None
    config: str | None = None
    related: str | None = None


Rule = Ignore | Bind | Filter


@dataclass(frozen=True)
class InputSpec:
    paths: tuple[str, ...]
    file_type: str = "text"
    data_type: str = "struct"
    check: str = "all"
    fields: tuple[str, ...] = ()  # dotted columns to read; empty: whatever the plan needs


@dataclass(frozen=True)
class TopFilter:
    """Keeps the ``n`` rows with the largest ``key`` of each report period at export."""

    key: str
    n: int


@dataclass(frozen=True)
class OutputSpec:
    type: str = "mysql"
    params: Mapping[str, str] = field(default_factory=dict)
    tables: Mapping[Frequency, str] = field(default_factory=dict)
    top: tuple[TopFilter, ...] = ()


@dataclass(frozen=True)
class ConfigSource:
    id: str
    type: str  # DB or HDFS
    path: str | None = None
    sql: str | None = None
    params: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True, order=True)
class Priority:
    """``strong.weak``: smaller strong numbers are barriers before larger ones, weak ones order launches."""

    strong: int = 0
    weak: int = 0

    @staticmethod
    def parse(text: str) -> Priority:
        strong, _, weak = text.strip().partition(".")
        return Priority(int(strong or 0), int(weak or 0))


@dataclass(frozen=True)
class ReportSpec:
    name: str
    dimensions: tuple[Dimension, ...]
    targets: tuple[Target, ...]
    input: InputSpec | None = None
    output: OutputSpec = OutputSpec()
    configs: tuple[ConfigSource, ...] = ()
    rules: tuple[Rule, ...] = ()
    min_freq: Frequency = Frequency.Daily
    priority: Priority = Priority()
    transform: Callable | None = field(default=None, compare=False)  # (DataFrame, Context) -> DataFrame
    across_periods: bool = False  # the transform keeps the column period_start and doesn't ask for the period: one scan for many periods

    @property
    def dims(self) -> list[str]:
        """Dimension names, sorted: the order of the key."""
        return sorted(d.name for d in self.dimensions)

    @property
    def simple_name(self) -> str:
        return self.name.rstrip("/").rpartition("/")[2]

    def table_name(self, freq: Frequency) -> str:
        return self.output.tables.get(freq, f"{self.simple_name}{freq.value}")

    def with_transform(self, transform: Callable) -> ReportSpec:
        return replace(self, transform=transform)

    def validate(self) -> list[str]:
        """Raises SpecError for a definition that can't be run; returns warnings."""
        from latticework.plans.cuboid import resolve

        if not self.dimensions or not self.targets:
            raise SpecError(f"{self.name}: a report has dimensions and targets")
        names = [d.name for d in self.dimensions] + [t.name for t in self.targets]
        if double := {n for n in names if [m.lower() for m in names].count(n.lower()) > 1}:
            raise SpecError(f"{self.name}: defined twice: {sorted(double)}")
        for t in self.targets:
            if t.type in UNSUPPORTED_METRICS:
                raise SpecError(f"{self.name}.{t.name}: metric type {t.type} isn't supported")
            if t.type not in METRIC_TYPES:
                raise SpecError(f"{self.name}.{t.name}: unknown metric type {t.type}")
            if t.type == "RANGEDIST":
                parse_range(t.param)
            if t.type == "VALUEDIST" and t.param is not None:
                int(t.param)
        if self.input:
            for value, known in ((self.input.file_type, FILE_TYPES), (self.input.data_type, DATA_TYPES), (self.input.check, CHECKS)):
                if value not in known:
                    raise SpecError(f"{self.name}: {value!r} isn't one of {known}")
        if self.output.type not in OUTPUTS:
            raise SpecError(f"{self.name}: unknown output {self.output.type}")
        ids = {c.id for c in self.configs}
        for rule in self.rules:
            if isinstance(rule, Filter):
                if rule.kind not in ("WList", "BList"):
                    raise SpecError(f"{self.name}: filter type {rule.kind!r}")
                if (rule.values is None) == (rule.config is None):
                    raise SpecError(f"{self.name}: a filter has a list or a configured list")
                if rule.config is not None and rule.config not in ids:
                    raise SpecError(f"{self.name}: no config {rule.config!r}")
        return resolve(self.dims, self.rules).warnings


def parse_range(param: str | None) -> tuple[float, float, float]:
    """(min, step, max) of ``min~step~max``."""
    try:
        low, step, high = (float(p) for p in (param or "").split("~"))
    except ValueError as e:
        raise SpecError(f"RANGEDIST needs min~step~max, not {param!r}") from e
    if step <= 0 or high < low:
        raise SpecError(f"RANGEDIST {param!r}: the step is positive and min at most max")
    return low, step, high


def _names(text: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in text.split(",") if n.strip())


def _filter(dimension: str, kind: str, source: str, split: str | None, text: str) -> Filter:
    related, _, dim = dimension.rpartition(".")
    if source == "config":
        return Filter(dim.strip(), kind, config=text.strip(), related=related.strip() or None)
    values = tuple(v.strip() for v in text.split(split or ",") if v.strip())
    return Filter(dim.strip(), kind, values=values, related=related.strip() or None)


def from_xml(source: str | Path, name: str, transform: Callable | None = None) -> ReportSpec:
    """A report definition from its XML text or file."""
    text = Path(source).read_text() if isinstance(source, Path) else source
    root = ET.fromstring(text.encode())
    body = lambda e: (e.text or "").strip()
    inp = root.find("input")
    get = lambda tag, default: body(inp.find(tag)) if inp.find(tag) is not None else default
    kind = get("file_type", "text")
    read = None
    if inp is not None:
        read = InputSpec(tuple(body(p) for p in inp.findall("path")), _SEQUENCE_NAMES.get(kind.lower(), kind), get("data_type", "struct"), get("check", "all"), tuple(f for e in inp.findall("parquet_schema_subfields") for f in _names(body(e))))
    out = root.find("output")
    write = OutputSpec()
    if out is not None:
        tables = {Frequency(p.split(":")[0].strip()): p.split(":")[1].strip() for e in out.findall("FreqTableName") for p in body(e).split(",")}
        top = tuple(TopFilter(e.get("key"), int(e.get("param"))) for e in out.findall("filter") if e.get("type", "").lower() == "top")
        write = OutputSpec(body(out.find("type")) if out.find("type") is not None else "mysql", dict(out.find("param").attrib) if out.find("param") is not None else {}, tables, top)
    configs = tuple(ConfigSource(e.get("id"), e.get("type"), body(e.find("path")) if e.find("path") is not None else None, body(e.find("sql")) if e.find("sql") is not None else None, dict(e.find("param").attrib) if e.find("param") is not None else {}) for e in root.findall("config"))
    report = root.find("report")
    rules: list[Rule] = []
    for e in report.find("cuboid") if report.find("cuboid") is not None else ():
        tag = e.tag.lower()
        if tag == "ignore":
            rules.append(Ignore(_names(body(e))))
        elif tag == "bind":
            rules.append(Bind(_names(body(e))))
        elif tag == "filter":
            rules.append(_filter(e.get("dimension"), e.get("type"), e.get("source"), e.get("split"), e.text or ""))
    optional = lambda tag, make, default: make(body(report.find(tag))) if report.find(tag) is not None else default
    return ReportSpec(
        name,
        tuple(Dimension(e.tag, e.get("value")) for e in report.find("dimension")),
        tuple(Target(e.tag, e.get("type"), e.get("param"), e.get("value")) for e in report.find("target")),
        read,
        write,
        configs,
        tuple(rules),
        optional("minFreq", Frequency, Frequency.Daily),
        optional("priority", Priority.parse, Priority()),
        transform,
    )


def from_dict(data: Mapping[str, Any], transform: Callable | None = None) -> ReportSpec:
    """A report definition from plain values, for instance read from JSON."""
    rules: list[Rule] = []
    for rule in data.get("rules", ()):
        (kind, value), *rest = rule.items()
        if kind == "ignore":
            rules.append(Ignore(tuple(value)))
        elif kind == "bind":
            rules.append(Bind(tuple(value)))
        elif kind == "filter":
            rules.append(Filter(**{**value, "values": tuple(value["values"]) if value.get("values") is not None else None}))
        else:
            raise SpecError(f"unknown rule {kind!r}")
    make = lambda cls, item: cls(**item) if isinstance(item, Mapping) else cls(item)
    read = data.get("input")
    out = dict(data.get("output", {}))
    out["tables"] = {Frequency(k): v for k, v in out.get("tables", {}).items()}
    out["top"] = tuple(TopFilter(**t) for t in out.get("top", ()))
    return ReportSpec(
        data["name"],
        tuple(make(Dimension, d) for d in data["dimensions"]),
        tuple(Target(**t) for t in data["targets"]),
        InputSpec(**{**read, "paths": tuple(read["paths"]), "fields": tuple(read.get("fields", ()))}) if read else None,
        OutputSpec(**out),
        tuple(ConfigSource(**c) for c in data.get("configs", ())),
        tuple(rules),
        Frequency(data.get("min_freq", "Daily")),
        Priority.parse(str(data.get("priority", "0.0"))),
        transform,
    )
