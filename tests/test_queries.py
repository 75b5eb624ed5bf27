"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def tidy(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(__spark_entry__.oracle_sql()[name])
    names = relation.columns
    assert sorted(names) == columns
    want = sorted((tuple(tidy(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert got == want


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert all(callable(q) for q in queries.values())


def test_all_else_imports_without_the_optional_folder(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "latticework", tmp_path / "latticework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert 'cube_3d' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_optional_folder():
    root = Path(__spark_entry__.__file__).parent / "latticework"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "latticework.llm" not in path.read_text(), path
