"""Every registered query with SQL gives what the SQL gives, on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(request):
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    """One text for equal values: pandas turns whole numbers into floats where a column has nulls."""
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(float(value))
    return str(value)


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_reads_only_what_it_needs(spark, sf_dir):
    plan = QUERIES["matched_strata"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "Python" not in plan


def test_cleaned_requests_keep_6000_characters(spark, tmp_path):
    texts = [f"{'é b ' * (n // 4)}{'x' * (n % 4)}" for n in (0, 50, 101, 5999, 6000, 6001, 9000)] + ["a \n\t b  " * 1500, "y" * 6000 + " tail"]
    spark.createDataFrame([(i, 0, "user", s) for i, s in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: (r["cleaned"], r["long"]) for r in QUERIES["cleaned_requests_in_full"](spark, str(tmp_path)).collect()}
    assert found == {i: (" ".join(s.split())[:6000], len(s) > 6000) for i, s in enumerate(texts)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {i: (c, n) for i, c, n in con.sql(f"SELECT conv_id, cleaned, long FROM ({ORACLES['cleaned_requests_in_full']})").fetchall()} == found
