from __future__ import annotations

import itertools
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from latticework.plans.cuboid import resolve
from latticework.plans.frequency import Frequency, add_months, format_period, parse_period
from latticework.plans.schedule import Work, build
from latticework.plans.spec import Bind, Dimension, Filter, Ignore, InputSpec, Priority, ReportSpec, SpecError, Target, from_dict, from_xml, parse_range

START = datetime(2024, 1, 31)


@pytest.mark.parametrize(("freq", "end"), [("Hourly", datetime(2024, 1, 31, 1)), ("Daily", datetime(2024, 2, 1)), ("Weekly", datetime(2024, 2, 7)), ("Monthly", datetime(2024, 2, 29)), ("Thirtydays", datetime(2024, 3, 1)), ("Quarterly", datetime(2024, 4, 30)), ("HalfYearly", datetime(2024, 7, 31)), ("Yearly", datetime(2025, 1, 31))])
def test_period_ends(freq, end):
    assert Frequency(freq).end(START) == end


def test_children():
    day = datetime(2024, 2, 1)
    assert len(Frequency.Daily.children(day)) == 24
    assert [len(f.children(day)) for f in (Frequency.Weekly, Frequency.Monthly, Frequency.Thirtydays)] == [7, 29, 30]
    assert [len(f.children(day)) for f in (Frequency.Quarterly, Frequency.HalfYearly, Frequency.Yearly)] == [3, 6, 12]
    assert Frequency.Hourly.children(day) == [] and Frequency.Hourly.child is None
    assert Frequency.Daily.date_dir(day) == "2024-02-01" and Frequency.Hourly.date_dir(day + timedelta(hours=7)) == "2024-02-01/07"


@given(st.datetimes(datetime(2000, 1, 1), datetime(2030, 1, 1)), st.sampled_from(list(Frequency)[1:]))
def test_children_cover_the_period(start, freq):
    starts = freq.children(start)
    assert starts[0] == start and all(a < b for a, b in itertools.pairwise(starts)) and starts[-1] < freq.end(start)


def test_month_steps_and_texts():
    assert add_months(datetime(2023, 11, 30), 3) == datetime(2024, 2, 29)
    assert parse_period("2024-01-31T00:00Z") == START and format_period(START) == "2024-01-31T00:00Z"
    assert Frequency.Weekly.coarser_than(Frequency.Daily) and not Frequency.Daily.coarser_than(Frequency.Daily)


def kinds(plan):
    return plan.ignored, plan.leaders, set(plan.filters)


def F(d, kind="WList", values=("x",), **more):
    return Filter(d, kind, values, **more)


@pytest.mark.parametrize(
    ("rules", "ignored", "leaders", "filters"),
    [
        ([], set(), {}, set()),
        ([Ignore(("A",))], {"a"}, {}, set()),
        ([F("a"), Ignore(("a",))], {"a"}, {}, set()),
        ([Bind(("a", "b")), Ignore(("a",))], {"a", "b"}, {}, set()),
        ([Bind(("a", "b")), Ignore(("b",))], {"b"}, {"a": ("a", "b")}, set()),
        ([Ignore(("a",)), Bind(("a", "b"))], {"a"}, {}, set()),
        ([F("a"), Bind(("a", "b"))], set(), {}, {"a"}),
        ([F("b"), Bind(("a", "b"))], {"b"}, {"a": ("a", "b")}, set()),
        ([Bind(("b", "c")), Bind(("a", "b"))], {"b", "c"}, {"a": ("a", "b")}, set()),
        ([Bind(("a", "b")), Bind(("a", "c"))], {"b", "c"}, {"a": ("a", "b", "c")}, set()),
        ([Ignore(("b",)), Bind(("a", "b"))], {"b"}, {"a": ("a", "b")}, set()),
        ([Bind(("a", "b")), F("a")], {"b"}, {"a": ("a", "b")}, set()),
        ([Bind(("a", "b")), F("b")], {"b"}, {"a": ("a", "b")}, set()),
        ([F("a"), F("a", "BList")], set(), {}, {"a"}),
        ([F("a", related="b")], {"b"}, {}, {"a"}),
        ([Bind(("b", "c")), F("a", related="b")], {"b", "c"}, {}, {"a"}),
        ([F("b"), F("a", related="b")], {"b"}, {}, {"a"}),
    ],
)
def test_rule_resolution(rules, ignored, leaders, filters):
    assert kinds(resolve(["c", "a", "b"], rules)) == (ignored, leaders, filters)


@pytest.mark.parametrize("rules", [[Ignore(("z",))], [Bind(("a", "z"))], [F("z")], [F("a", related="z")], [F("a", related="a")], [Bind(("a", "b")), F("c", related="b")]])
def test_rules_that_cannot_hold(rules):
    with pytest.raises(SpecError):
        resolve(["a", "b", "c"], rules)


def test_first_filter_wins_and_warnings():
    plan = resolve(["a", "b"], [F("a"), F("a", "BList")])
    assert plan.filters["a"].kind == "WList" and len(plan.warnings) == 1


def test_roll_ups_are_every_subset_once():
    ups = resolve(["a", "b", "c", "d"], [Bind(("a", "c")), F("b"), Ignore(("d",))]).roll_ups()
    assert [u.dims for u in ups] == [(), ("a", "c"), ("b",), ("a", "b", "c")]
    assert [len(u.filters) for u in ups] == [0, 0, 1, 1]
    assert len(resolve(list("abcde"), []).roll_ups()) == 32


def spec(name="r", priority="1.0", check="all", path="in/%Y%M%D/%H", min_freq=Frequency.Hourly, **more):
    return ReportSpec(name, (Dimension("d"),), (Target("t", "SUM"),), InputSpec((path,), check=check), priority=Priority.parse(priority), min_freq=min_freq, **more)


@pytest.mark.parametrize(
    "bad",
    [
        {"targets": ()},
        {"dimensions": ()},
        {"targets": (Target("t", "PV"),)},
        {"targets": (Target("t", "MEDIAN"),)},
        {"targets": (Target("d", "SUM"),)},
        {"targets": (Target("t", "RANGEDIST"),)},
        {"targets": (Target("t", "RANGEDIST", "5~1~2"),)},
        {"input": InputSpec(("p",), check="most")},
        {"input": InputSpec(("p",), "csv")},
        {"rules": (Filter("d", "GList", ("x",)),)},
        {"rules": (Filter("d", "WList"),)},
        {"rules": (Filter("d", "WList", config="nope"),)},
    ],
)
def test_validation(bad):
    with pytest.raises(SpecError):
        ReportSpec(**{**spec().__dict__, **bad}).validate()


def test_definitions():
    xml = """<ReportConfig><input><path>a/%Y</path><path>b</path><file_type>parquet</file_type><check>part</check><parquet_schema_subfields>x.y, z</parquet_schema_subfields></input>
    <output><type>phoenix</type><param ip="h"/><FreqTableName>Hourly:H,Daily:D</FreqTableName><filter key="t" type="Top" param="5"/></output>
    <config type="HDFS" id="l"><path>list</path></config>
    <report><dimension><p/><q value="upper(q)"/></dimension><target><t type="SUM" value="1"/><v type="VALUEDIST" param="3"/></target><minFreq>Hourly</minFreq><priority>10.3</priority>
    <cuboid><ignore>p</ignore><bind>p, q</bind><filter dimension="p.q" type="BList" source="list" split=";">a\tb;c\td</filter><filter dimension="q" type="WList" source="config">l</filter></cuboid></report></ReportConfig>"""
    s = from_xml(xml, "dir/Name")
    assert s.input == InputSpec(("a/%Y", "b"), "parquet", "struct", "part", ("x.y", "z"))
    assert s.rules == (Ignore(("p",)), Bind(("p", "q")), Filter("q", "BList", ("a\tb", "c\td"), related="p"), Filter("q", "WList", config="l"))
    assert s.priority == Priority(10, 3) and s.dims == ["p", "q"] and s.output.top[0].n == 5
    assert (s.table_name(Frequency.Daily), s.table_name(Frequency.Weekly)) == ("D", "NameWeekly")
    again = from_dict({"name": "dir/Name", "dimensions": ["p", {"name": "q", "value": "upper(q)"}], "targets": [{"name": "t", "type": "SUM", "value": "1"}, {"name": "v", "type": "VALUEDIST", "param": "3"}], "input": {"paths": ["a/%Y", "b"], "file_type": "parquet", "check": "part", "fields": ["x.y", "z"]}, "output": {"type": "phoenix", "params": {"ip": "h"}, "tables": {"Hourly": "H", "Daily": "D"}, "top": [{"key": "t", "n": 5}]}, "configs": [{"id": "l", "type": "HDFS", "path": "list"}], "rules": [{"ignore": ["p"]}, {"bind": ["p", "q"]}, {"filter": {"dim": "q", "kind": "BList", "values": ["a\tb", "c\td"], "related": "p"}}, {"filter": {"dim": "q", "kind": "WList", "config": "l"}}], "min_freq": "Hourly", "priority": "10.3"})
    assert again == s
    assert parse_range("0~10~40") == (0, 10, 40)


def test_plan_schedules_children_and_skips_what_exists():
    day = datetime(2024, 1, 1)
    there = {("r", "Hourly", day + timedelta(hours=h)) for h in range(20)}
    plan = build([Work(spec(), Frequency.Daily, day)], lambda w: w.key in there)
    assert len(plan.units) == 5 and [len(w) for w in plan.levels()] == [4, 1]
    assert not build([Work(spec(), Frequency.Hourly, day)], lambda w: True).units
    assert len(build([Work(spec(), Frequency.Hourly, day)], lambda w: True, force=True).units) == 1
    # children are never forced, and only a check of all schedules them
    assert len(build([Work(spec(), Frequency.Daily, day)], lambda w: True, force=True).units) == 1
    assert len(build([Work(spec(check="part"), Frequency.Daily, day)], lambda w: False).units) == 1
    assert len(build([Work(spec(min_freq=Frequency.Daily), Frequency.Quarterly, day)], lambda w: False).units) == 1 + 3 + 31 + 29 + 31


def test_plan_fuses_equal_inputs_and_orders_by_priority():
    day = datetime(2024, 1, 1)
    specs = [spec("a", "1.2"), spec("b", "1.1"), spec("c", "0.9"), spec("d", "1.0", path="other/%H"), spec("e", "1.0", path="in/%Y%M%D/%H")]
    plan = build([Work(s, Frequency.Hourly, day) for s in specs], lambda w: False)
    assert sorted(sorted(w.spec.name for w in u.works) for u in plan.units) == [["a", "b", "e"], ["c"], ["d"]]
    names = [[sorted(w.spec.name for w in plan.units[i].works) for i in wave] for wave in plan.levels()]
    assert names[0] == [["c"]] and sorted(names[1]) == [["a", "b", "e"], ["d"]]


def test_plan_rejects_grains_that_cannot_be():
    with pytest.raises(ValueError, match="finer"):
        build([Work(spec(min_freq=Frequency.Weekly), Frequency.Monthly, START)], lambda w: False)
    with pytest.raises(ValueError, match="finer"):
        build([Work(spec(min_freq=Frequency.Daily), Frequency.Hourly, START)], lambda w: False)
