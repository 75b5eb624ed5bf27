"""Embedded databases, which only the driver's process can open."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import datetime
from importlib.util import find_spec
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from latticework.jdbc import embedded, write_rows
from latticework.plans.spec import ConfigSource
from latticework.sinks.export import JdbcSink
from latticework.sources.lists import config_table

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
at, sf, *names = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{at}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("ROWS" + json.dumps({n: [[r[c] for c in sorted(r.asDict())] for r in __spark_entry__.queries()[n](spark, sf).collect()] for n in names}))
"""


def test_executors_in_other_processes(sf, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(find_spec("pyspark").origin).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "own").mkdir()
    con, small = duckdb.connect(), tmp_path / "tables"
    small.mkdir()
    for t, some in (("part", "true"), ("events", "ts < '2024-01-03' AND hour(ts) < 2")):
        con.execute(f"COPY (SELECT * FROM read_parquet('{sf}/{t}.parquet') WHERE {some}) TO '{small}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "TMPDIR": str(tmp_path / "own"), "PYTHONPATH": str(Path(__spark_entry__.__file__).parent)}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_ENV_LOADED"):
        env.pop(k, None)
    names = ["reject_sink", "export_hours"]
    ran = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), str(small), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]
    got = json.loads(next(line for line in ran.stdout.splitlines() if line.startswith("ROWS"))[4:])
    for name in names:
        want = con.sql(__spark_entry__.oracle_sql()[name])
        assert got[name]
        order = sorted(range(len(want.columns)), key=want.columns.__getitem__)
        assert sorted(map(tuple, got[name]), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert not list((tmp_path / "own").glob("latticework-derby-*"))


def test_rows_come_to_the_driver_a_batch_at_a_time(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sink = JdbcSink(spark, url, driver=DRIVER)
    sink.execute("CREATE TABLE T (K BIGINT, V CLOB, S TIMESTAMP)")
    rows = [(i, None if i % 7 == 0 else "é" * i, datetime(2024, 1, 1, i % 24)) for i in range(95)]
    df = spark.createDataFrame(rows, "K long, V string, S timestamp").coalesce(1)
    repartitioned = []
    monkeypatch.setattr(type(df), "repartition", lambda self, n, f=type(df).repartition: repartitioned.append(n) or f(self, n))
    sink.append(df, "T", 10)
    assert repartitioned == [10]
    sink.append(df.where("K < 0"), "T", 10)
    sink.execute("CREATE TABLE Few (K BIGINT, V CLOB, S TIMESTAMP)")
    sink.append(df.limit(10), "Few", 10)
    assert repartitioned == [10]  # a batch comes in one run of the plan
    monkeypatch.setattr("latticework.sinks.export.read_rows", lambda *a, f=sys.modules["latticework.jdbc"].read_rows: f(*a, batch=10))
    got = sink.select("SELECT * FROM T")
    sink.execute("DROP TABLE T")  # what was read stays
    assert sorted(map(tuple, got.collect())) == rows and got.columns == ["K", "V", "S"]
    monkeypatch.undo()
    write_rows(df.limit(0), url, "Made", {"driver": DRIVER})
    assert sink.select("SELECT * FROM Made").count() == 0


def test_a_list_from_an_embedded_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sink = JdbcSink(spark, url, driver=DRIVER)
    sink.execute("CREATE TABLE L (A VARCHAR(9), B INTEGER)", "INSERT INTO L VALUES ('x', 1), ('y', NULL)")
    table = config_table(spark, ConfigSource("l", "DB", sql="SELECT * FROM L", params={"url": url, "driver": DRIVER}), datetime(2024, 1, 1))
    sink.execute("DROP TABLE L")
    assert sorted(r["value"] for r in table.collect()) == ["x\t1", "y\t"]


@pytest.mark.parametrize("url, here", [("jdbc:derby:memory:a", True), ("jdbc:derby:/a/b;create=true", True), ("jdbc:derby://host:1527/a", False), ("jdbc:h2:mem:a", True), ("jdbc:h2:tcp://host/a", False), ("jdbc:hsqldb:hsql://host/a", False), ("jdbc:sqlite:/a", True), ("jdbc:mysql://host/a", False), ("jdbc:phoenix:host", False)])
def test_which_databases_are_embedded(url, here):
    assert embedded(url) is here
