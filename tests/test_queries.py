"""Every registered query of the engine runs, and equals its SQL where there is some."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from landrank.operators import scorers
from landrank.plans.oracle import ORACLE
from landrank.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    found = duckdb.connect()
    for name in os.listdir(FOLDER):
        found.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert df.columns
    if name not in ORACLE:
        assert rows
        return
    cursor = db.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([[plain(r[columns.index(c)]) for c in sorted(columns)] for r in cursor.fetchall()], key=str)
    got = sorted([[plain(r[c]) for c in sorted(columns)] for r in rows], key=str)
    assert got == want


@pytest.mark.parametrize("name", ["hydro", "elevation", "access", "solar", "buildable"])
def test_failed_criterion_is_no_result(spark, db, monkeypatch, name):
    """Parcels get no scores with 0 for a criterion that could not be worked out."""
    monkeypatch.setitem(scorers._known, name, lambda cells, context: cells.select("cell_id", F.col("no_such_column").alias("score")))
    with pytest.raises(AnalysisException, match="no_such_column"):
        QUERIES["q_parcel_scores"](spark, FOLDER)


def test_lost_table_is_no_result(spark, db, monkeypatch, tmp_path):
    """The zonal sums, of which three criteria are made, are not there when they are read again."""
    monkeypatch.setattr(scorers, "stored", lambda df, label: spark.read.schema(df.schema).parquet(str(tmp_path / "gone")))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        QUERIES["q_parcel_scores"](spark, FOLDER)


def test_entry_registers_queries(spark):
    names = entry.queries()
    assert set(QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns


def test_entry_without_training_operators(tmp_path):
    """A copy without the training-data folders imports and still has the engine's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "landrank", tmp_path / "landrank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_rank' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert 'q_rank' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
