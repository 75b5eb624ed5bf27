from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from latticework import cli
from latticework.engine import Engine, RunError, columns_read
from latticework.functions import accessors as A
from latticework.plans.frequency import Frequency
from latticework.plans.spec import ConfigSource, Dimension, InputSpec, OutputSpec, ReportSpec, SpecError, Target, TopFilter
from latticework.functions.rows import RowError, checked, emit_rows
from latticework.operators.cube import States
from latticework.plans.schedule import Work
from latticework.sinks.export import JdbcSink, StrictInsertError, TableColumn, UnsupportedSink, export, parse_aliases, project, reject_rows, rejects, top_rows, truncate_bytes, upsert_statement
from latticework.sinks.store import StateStore
from latticework.sources.lists import load_lists
from latticework.sources.paths import MissingInput, expand, matching, resolve, strictest
from latticework.sources.readers import UnsupportedSource, read, read_avro, with_file
from latticework.streaming.increments import period_start, read_stream_states, start_stream

DAY = datetime(2024, 1, 1)


def test_templates():
    assert expand(["a/%Y-%M-%D/%H", "b/%Y%M"], DAY, datetime(2024, 1, 1, 2)) == ["a/2024-01-01/00", "a/2024-01-01/01", "b/202401"]
    assert strictest(["no", "all", "part"]) == "all" and strictest(["no", "part"]) == "part"


def test_completeness(spark, tmp_path):
    (tmp_path / "x" / "00").mkdir(parents=True)
    (tmp_path / "x" / "00" / "f").write_text("line\n")
    spec = lambda check: InputSpec((str(tmp_path / "x/%H"),), check=check)
    two = datetime(2024, 1, 1, 2)
    assert len(resolve(spark, spec("part"), DAY, two)) == 1
    assert len(resolve(spark, InputSpec(("x/%H",), check="no"), DAY, two, str(tmp_path))) == 1
    with pytest.raises(MissingInput, match="1 of 2"):
        resolve(spark, spec("all"), DAY, two)
    with pytest.raises(MissingInput, match="no input"):
        resolve(spark, InputSpec((str(tmp_path / "none/%H"),), check="no"), DAY, two)
    assert len(resolve(spark, InputSpec((str(tmp_path / "x/0*"),)), DAY, two)) == 1
    (tmp_path / "x" / "a,b").mkdir()
    some = [str(tmp_path / "x" / n) for n in ("00", "a", "a,b", "01")] + [str(tmp_path / "y" / "00")]
    assert [len(h) for h in matching(spark, some).values()] == [1, 0, 1, 0, 0]
    assert matching(spark, some[:1])[some[0]][0].endswith("/x/00")
    (tmp_path / "x" / "a,b").rmdir()
    assert [len(h) for h in matching(spark, some).values()] == [1, 0, 0, 0, 0]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2], {"k": 5}), (2, None, None, None)], "i int, s string, l array<int>, m map<string,int>").withColumn("r", F.struct(F.col("i").alias("x"), F.struct(F.lit("deep").alias("z"), F.lit(0).alias("unused")).alias("y")))
    for kind in ("parquet", "orc"):
        df.write.mode("overwrite").format(kind).save(str(tmp_path / kind))
        got = read(spark, InputSpec(("",), kind, fields=("s", "r.y.z")), [str(tmp_path / kind)])
        assert got.schema.simpleString() == "struct<s:string,r:struct<y:struct<z:string>>>"
        assert sorted(map(str, got.collect())) == sorted(["Row(s='a', r=Row(y=Row(z='deep')))", "Row(s=None, r=Row(y=Row(z='deep')))"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "unused" not in plan
    more = read(spark, InputSpec(("",), "parquet"), [str(tmp_path / "parquet")], "i int, missing string")
    assert more.where("missing is null").count() == 2
    (tmp_path / "t").write_text("a\tb\t\n\tc")
    text = read(spark, InputSpec(("",)), [str(tmp_path / "t")]).select(A.split_line().alias("p"))
    assert [r["p"] for r in text.collect()] == [["a", "b", ""], ["", "c"]]
    (tmp_path / "j").write_text('{"a": {"b": 1}}\n{"a": {"b": 2}}\n')
    assert read(spark, InputSpec(("",), "text", "json"), [str(tmp_path / "j")]).agg(F.sum("a.b")).first()[0] == 3
    (tmp_path / "bad").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, InputSpec(("",), "text", "json"), [str(tmp_path / "bad")]).collect()
    with pytest.raises(SpecError):
        read(spark, InputSpec(("",), "csv"), ["x"])
    with pytest.raises(UnsupportedSource):
        read_avro(spark, [str(tmp_path / "t")])
    named = with_file(spark.read.text(str(tmp_path / "t"))).first()
    assert named["file_name"] == "t" and named["file_path"].endswith("/t")


def test_accessors(spark):
    df = spark.createDataFrame([("12", "x", True, [7], {"k": "v"}, None, " ", "EMPTY")], "n string, s string, b boolean, l array<int>, m map<string,string>, e string, blank string, em string")
    r = df.select(
        A.get_long("n", 0).alias("a"), A.get_long("b").alias("b"), A.get_long("e", 9).alias("c"), A.try_long("s", -1).alias("d"), A.get_double("n").alias("e"), A.try_double("s", 0.5).alias("f"), A.get_boolean("b").alias("g"), A.get_boolean("s").alias("h"), A.get_boolean("e", True).alias("i"),
        A.get_string("e", "z").alias("j"), A.get_string(F.lit(""), "z", True).alias("k"), A.element("l", 0).alias("l"), A.element("l", 5).alias("m"), A.get_map("m", "k").alias("o"), A.is_empty("e").alias("p"), A.is_empty("blank").alias("q"), A.is_empty("em").alias("r"), A.is_empty("s").alias("s"), A.get_float("n").alias("t"), A.get_int("e", 3).alias("u"),
    ).first()
    assert tuple(r) == (12, 1, 9, -1, 12.0, 0.5, True, False, True, "z", "z", 7, None, "v", True, True, True, False, 12.0, 3)
    flags = df.select(*(A.get_boolean(F.lit(v)).alias(f"c{i}") for i, v in enumerate((1.0, 1, 0, 2.5, "1", "yes", "TRUE")))).first()
    assert tuple(flags) == (True, True, False, False, True, False, True)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(A.get_long("s")).collect()


def log_spec(root, name="log", min_freq=Frequency.Hourly, check="all", **more):
    def transform(df, context):
        assert context.report_date.startswith("2024-01-01") and context.shared["tag"] == "t"
        part = A.split_line()
        return df.select(part[0].alias("area"), part[1].alias("browser"), part[2].alias("uid")).where(~A.is_empty("uid")).withColumn("id", F.col("uid").cast("long"))

    return ReportSpec(name, (Dimension("area"), Dimension("browser")), (Target("times", "SUM", value="1"), Target("users", "UVBITMAP", value="id"), Target("kinds", "VALUEDIST", "1", "browser"), Target("about", "UV_HYPERLOGLOGPLUS", value="uid")), InputSpec((f"{root}/%Y-%M-%D/%H",), check=check), min_freq=min_freq, transform=transform, **more)


@pytest.fixture
def log(tmp_path):
    for h in range(24):
        folder = tmp_path / "log" / "2024-01-01" / f"{h:02}"
        folder.mkdir(parents=True)
        (folder / "part").write_text("".join(f"{'ab'[i % 2]}\t{'xyz'[i % 3]}\t{i + h if i % 7 else ''}\n" for i in range(30)))
    return tmp_path / "log"


def values(df):
    return sorted((r["area"], r["browser"], r["times"], r["users"], r["kinds"], r["about"]) for r in df.collect())


def test_day_from_hours_equals_day_from_the_log(spark, log, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), shared={"tag": "t"}, threads=6)
    hourly, daily = log_spec(log), log_spec(log, "direct", Frequency.Daily)
    done = engine.run([hourly], Frequency.Daily, DAY)
    assert len(done) == 25
    engine.run([daily], Frequency.Daily, DAY)
    assert values(engine.result(hourly, Frequency.Daily, DAY)) == values(engine.result(daily, Frequency.Daily, DAY))
    assert engine.run([hourly], Frequency.Daily, DAY) == []
    assert len(engine.run([hourly], Frequency.Daily, DAY, force=True)) == 1
    assert engine.store.describe(hourly, Frequency.Daily, DAY)["present"] == 24
    periods = engine.store.read(hourly, Frequency.Hourly, Frequency.Daily.children(DAY)[:3], with_period=True)
    assert periods.extra == ["period_start"] and periods.rows.select("period_start").distinct().count() == 3


def test_failures_hold_up_only_what_needs_them(spark, log, tmp_path):
    for f in (log / "2024-01-01" / "05").iterdir():
        f.unlink()
    (log / "2024-01-01" / "05").rmdir()
    engine = Engine(spark, str(tmp_path / "store"), shared={"tag": "t"}, threads=6)
    with pytest.raises(RunError) as e:
        engine.run([log_spec(log)], Frequency.Daily, DAY)
    assert len(e.value.failures) == 1 and "05:00Z" in str(e.value)
    assert len(engine.store.present(log_spec(log), Frequency.Hourly, Frequency.Daily.children(DAY))) == 23
    assert not engine.store.exists(log_spec(log), Frequency.Daily, DAY)
    loose = log_spec(log, "log", check="part")
    engine.run([loose], Frequency.Daily, DAY)
    assert engine.store.describe(loose, Frequency.Daily, DAY)["present"] == 23
    with pytest.raises(RunError):
        engine.run([log_spec(log, "other", check="part")], Frequency.Daily, DAY)  # no states at all


def test_configured_lists(spark, tmp_path):
    (tmp_path / "list-2024").write_text("one\ntwo\n\n")
    source = ConfigSource("l", "HDFS", path="list-%Y")
    assert load_lists(spark, (source,), DAY, str(tmp_path)) == {"l": ["one", "two"]}
    assert load_lists(spark, (source,), DAY, str(tmp_path), short=1)["l"].count() == 2
    with pytest.raises(SpecError):
        load_lists(spark, (ConfigSource("l", "FTP"),), DAY)


def test_projection_and_rejects(spark):
    df = spark.createDataFrame([("a", 1, "x" * 9), ("ALL", None, None), ("ü" * 4, 3, "y")], "area string, times int, note string")
    assert parse_aliases(["T.region=area", "T.n = times ", "junk"]) == {"T": {"region": "area", "n": "times"}}
    out = project(df, ["region", "n", "none", "timestamp"], DAY, {"region": "area", "n": "times"})
    assert [tuple(r) for r in out.collect()] == [("a", "1", "0", "1704067200"), ("ALL", "0", "0", "1704067200"), ("üüüü", "3", "0", "1704067200")]
    assert project(df, ["timestamp"], DAY, timestamp="Date").first()[0] == "2024-01-01 00:00:00"
    assert project(df, ["AREA", "NOTE"], DAY, missing=" ", upper=True).collect()[1] == ("ALL", " ")
    good, bad = rejects(df, [TableColumn("area", "varchar(7)"), TableColumn("note", "tinytext", nullable=False), TableColumn("gone", nullable=False, default="1")])
    assert [r["area"] for r in good.collect()] == ["a"]
    told = {r["area"]: r["errorinfo"] for r in bad.collect()}
    assert told == {"ALL": "note: no value", "üüüü": "area: longer than 7 bytes"}
    row = reject_rows(bad, "me", "T" * 200, DAY).where("errorinfo like 'note%'").first()
    assert row["user"] == "me" and len(row["modelname"]) == 128 and row["context"] == '{"area":"ALL"}' and row["timestamp"] == 1704067200
    assert spark.range(1).select(truncate_bytes(F.lit("aüb"), 2).alias("t")).first()["t"] == "a"
    assert spark.range(1).select(truncate_bytes(F.lit("aüb"), 3).alias("t")).first()["t"] == "aü"
    with pytest.raises(StrictInsertError):
        export(df, [TableColumn("area", "varchar(7)")], DAY, strict=True)
    assert [r["times"] for r in top_rows(df, [TopFilter("times", 1)]).collect()] == [3]


def test_jdbc_period_is_replaced_in_one_transaction(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sink = JdbcSink(spark, url, driver=driver)
    sink.execute("CREATE TABLE REPORT (area VARCHAR(20), times BIGINT, ts BIGINT)")
    assert [c.name for c in sink.columns("REPORT")] == ["AREA", "TIMES", "TS"] and sink.columns("REPORT")[0].max_bytes == 20
    frame = lambda rows: spark.createDataFrame(rows, "AREA string, TIMES long, TS long")
    sink.replace_period(frame([("a", 1, 10), ("b", 2, 10)]), "REPORT", "TS", "10")
    sink.replace_period(frame([("a", 5, 20)]), "REPORT", "TS", "20")
    sink.replace_period(frame([("a", 7, 10)]), "REPORT", "TS", "10")
    with pytest.raises(Exception):  # noqa: B017
        sink.replace_period(frame([("x" * 30, 1, 10)]), "REPORT", "TS", "10")
    got = spark.read.format("jdbc").options(url=url, driver=driver, dbtable="REPORT").load()
    assert sorted(map(tuple, got.collect())) == [("a", 5, 20), ("a", 7, 10)]


def test_periods_written_at_once_lose_no_row(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sink = JdbcSink(spark, url, driver=driver)
    sink.execute("CREATE TABLE REPORT (area VARCHAR(20), times BIGINT, ts BIGINT)")
    frame = lambda hour, n: spark.range(n).selectExpr("concat('a', id) as AREA", "id as TIMES", f"{hour} as TS")
    with ThreadPoolExecutor(4) as pool:
        for attempt in range(2):  # the second replaces the first
            for f in [pool.submit(sink.replace_period, frame(h, 50 + h + attempt), "REPORT", "TS", str(h)) for h in range(24)]:
                f.result()
    got = {(r["TS"], r["n"]) for r in sink.select("SELECT TS, COUNT(*) AS \"n\" FROM REPORT GROUP BY TS").collect()}
    assert got == {(h, 51 + h) for h in range(24)}
    assert sink.select("SELECT COUNT(*) AS N FROM SYS.SYSTABLES WHERE LOWER(TABLENAME) LIKE '%stage%'").first()["N"] == 0


def test_a_failed_publication_leaves_the_old_period(spark, tmp_path):
    spec = ReportSpec("r", (Dimension("d"),), (Target("t", "SUM"),))
    store = StateStore(spark, str(tmp_path / "store"))
    states = lambda t: States(["d"], spec.targets, spark.createDataFrame([("a", 1, t, "2024-01-01T00-00")], "d string, _rows long, t long, period_start string"))
    for t in (1, 2, 3):
        store.write(spec, Frequency.Daily, [DAY], states(t))
    read = store.read(spec, Frequency.Daily, [DAY]).rows
    broken = states(4)
    broken.rows = broken.rows.withColumn("t", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.write(spec, Frequency.Daily, [DAY], broken)
    assert [r["t"] for r in store.read(spec, Frequency.Daily, [DAY]).rows.collect()] == [3]
    store.write(spec, Frequency.Daily, [DAY], states(5))
    assert [r["t"] for r in read.collect()] == [3]  # who read the version before still can
    assert [r["t"] for r in store.read(spec, Frequency.Daily, [DAY]).rows.collect()] == [5]
    place = tmp_path / "store" / "report=r" / "freq=Daily"
    assert len(list((place / "data").iterdir())) == 4
    store.keep = timedelta(seconds=-9)
    store.write(spec, Frequency.Daily, [DAY], states(6))
    assert len(list((place / "data").iterdir())) == 2 and [p.name.split("~")[:2] for p in (place / "published").iterdir() if p.name.count("~") == 2 and not p.name.startswith(".")] == [["2024-01-01T00-00", "5"]]


def test_reports_on_one_scan_hold_only_what_they_read(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", "b", 1, "z" * 9), ("a", "c", 2, "y")], "x string, y string, n long, unused string")
    df.write.parquet(str(tmp_path / "in"))
    specs = [ReportSpec(d, (Dimension(d),), (Target("n", "SUM"),), InputSpec((str(tmp_path / "in"),), "parquet"), transform=lambda df, _: df.withColumn("more", F.upper("unused"))) for d in ("x", "y")]
    held = []
    monkeypatch.setattr(type(df), "persist", lambda self, level: held.append(self) or self)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.run(specs, Frequency.Daily, DAY)
    assert len(held) == 1 and columns_read(held[0]) == {"x", "y", "n"}
    assert sorted(map(tuple, engine.result(specs[1], Frequency.Daily, DAY).collect())) == [("ALL", 3), ("b", 1), ("c", 2)]


def test_a_bad_period_fails_alone(spark, tmp_path):
    for h in range(4):
        folder = tmp_path / "log" / f"{h:02}"
        folder.mkdir(parents=True)
        (folder / "part").write_text("a\t1\n" if h != 2 else "a\tx\n")
    spec = ReportSpec("r", (Dimension("d"),), (Target("t", "SUM"),), InputSpec((f"{tmp_path}/log/%H",)), min_freq=Frequency.Hourly, transform=lambda df, _: df.select(A.split_line()[0].alias("d"), A.get_long(A.split_line()[1]).alias("t")))
    engine = Engine(spark, str(tmp_path / "store"))
    hours = Frequency.Daily.children(DAY)[:4]
    with pytest.raises(RunError) as e:
        engine.run([spec], Frequency.Hourly, hours)
    assert list(e.value.failures) == ["r Hourly 2024-01-01T02:00Z"]
    assert engine.store.present(spec, Frequency.Hourly, hours) == [hours[0], hours[1], hours[3]]
    got = engine.result(spec, Frequency.Hourly, [hours[0], hours[3]])
    assert sorted(map(tuple, got.collect())) == [(p, d, 1) for p in ("2024-01-01T00-00", "2024-01-01T03-00") for d in ("ALL", "a")]


def test_rows_by_key_and_single_statements(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sink = JdbcSink(spark, url, driver=driver)
    sink.execute("CREATE TABLE T (K VARCHAR(9) NOT NULL, V BIGINT)")
    assert sink.insert_row("T", {"K": "a", "V": 1}) == 1 and sink.insert_row("T", {"K": "b'; DROP", "V": 2}) == 1
    sink.upsert(spark.createDataFrame([("a", 7), ("c", 3)], "K string, V long"), "T", ["K"])
    assert sink.update_rows("T", {"V": 9}, {"K": "c"}) == 1 and sink.delete_rows("T", {"K": "b'; DROP"}) == 1
    assert sorted(map(tuple, sink.select("SELECT K, V FROM T").collect())) == [("a", 7), ("c", 9)]
    assert upsert_statement("T", "S", ["K", "V"], ["K"], "phoenix") == "UPSERT INTO T (K, V) SELECT K, V FROM S"
    assert upsert_statement("T", "S", ["K", "V"], ["K"], "mysql").endswith("ON DUPLICATE KEY UPDATE V = VALUES(V)")
    source = ConfigSource("l", "DB", sql="SELECT K, V FROM T WHERE V < %Y", params={"url": url, "driver": driver})
    assert sorted(load_lists(spark, (source,), DAY)["l"]) == ["a\t7", "c\t9"]


def test_row_transforms(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "i long, t string")
    parse = lambda r: ({"w": w, "n": r["i"], **({"x": 0.5} if w == "c" else {})} for w in (r["t"] or "").split())
    out = emit_rows(df, parse, "w string, n long, x double")
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 1, None), ("b", 1, None), ("c", 3, 0.5)]
    for bad in ({"w": None}, {"w": 1}, {"n": True}, {"n": 1.5}, {"y": 1}):
        with pytest.raises(RowError):
            checked(bad, {"w": str, "n": int, "x": float})
    with pytest.raises(RowError):
        emit_rows(df, parse, "w array<string>")
    assert checked({"x": 1, "n": 2}, {"w": str, "n": int, "x": float}) == {"x": 1, "n": 2}


def test_outputs_by_key_and_without_sink(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sink = JdbcSink(spark, url, driver=driver)
    sink.execute('CREATE TABLE rDaily (D VARCHAR(9) NOT NULL, T VARCHAR(9), "TIMESTAMP" VARCHAR(20) NOT NULL)')
    rows = spark.createDataFrame([("a", 1), ("b", None)], "d string, t long")
    write = cli.exporter(spark, {}, url, {"driver": driver}, False, "epoch", "me", None)
    spec = ReportSpec("r", (Dimension("d"),), (Target("t", "SUM"),), output=OutputSpec("phoenix"))
    for _ in range(2):
        write(Work(spec, Frequency.Daily, DAY), rows)
    got = sink.select("SELECT * FROM rDaily")
    assert sorted(map(tuple, got.collect())) == [("a", "1", "2024-01-01 00:00:00"), ("b", " ", "2024-01-01 00:00:00")]
    with pytest.raises(UnsupportedSink):
        write(Work(ReportSpec("r", spec.dimensions, spec.targets, output=OutputSpec("redis")), Frequency.Daily, DAY), rows)


def test_command_line(spark, log, tmp_path, capsys):
    folder = tmp_path / "Clicks"
    folder.mkdir()
    (folder / "report.def.xml").write_text("<ReportConfig><input><path>log/%Y-%M-%D/%H</path><check>all</check></input><report><dimension><area/></dimension><target><times type='SUM' value='1'/></target><minFreq>Daily</minFreq></report></ReportConfig>")
    (folder / "parse.py").write_text("from latticework.functions import accessors as A\n\n\ndef parse(df, context):\n    return df.select(A.split_line()[0].alias('area'))\n")
    (folder / "exportAliasName").write_text("ClicksDaily.AREA=area\nClicksDaily.TIMES=times\n")
    common = ["2024-01-01T00:00Z", "Daily", "--store", str(tmp_path / "store"), "--base-dir", str(tmp_path)]
    assert cli.main(["run", str(folder), *common]) == 0
    assert "done Clicks Daily" in capsys.readouterr().out
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sink = JdbcSink(spark, url, driver=driver)
    sink.execute('CREATE TABLE ClicksDaily (area VARCHAR(20), times BIGINT, "TIMESTAMP" BIGINT)')
    assert cli.main(["export", str(folder), *common, "--jdbc-url", url, "--jdbc-driver", driver]) == 0
    got = spark.read.format("jdbc").options(url=url, driver=driver, dbtable="ClicksDaily").load()
    assert sorted((r["AREA"], r["TIMES"]) for r in got.collect()) == [("ALL", 720), ("a", 360), ("b", 360)]
    assert cli.main(["export", str(folder), "2024-01-02T00:00Z", *common[1:], "--jdbc-url", url, "--jdbc-driver", driver]) == 1
    assert cli.main(["run", str(folder), "2024-01-02T00:00Z", *common[1:]]) == 1


def test_stream_batches_run_again_replace_themselves(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i % 2, i % 24), "ab"[i % 2], i) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v long")
    df.repartition(4, "v").write.parquet(str(tmp_path / "in"))
    spec = ReportSpec("s", (Dimension("k"),), (Target("v", "SUM"), Target("ids", "UVBITMAP", value="v")), min_freq=Frequency.Daily)
    root = str(tmp_path / "out")
    for attempt in range(2):  # a new checkpoint runs the same batches again
        records = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_stream(records, spec, F.col("ts"), root, str(tmp_path / f"checkpoint{attempt}")).awaitTermination()
    flat = read_stream_states(spark, spec, root).flat
    got = {(r["period_start"].day, r["k"]): r["v"] for r in flat.collect()}
    assert got[1, "ALL"] == sum(i for i in range(60) if i % 2 == 0) and got[2, "b"] == sum(i for i in range(60) if i % 2)
    with pytest.raises(ValueError):
        period_start(F.col("ts"), Frequency.Thirtydays)
    assert os.path.isdir(f"{root}/states")
