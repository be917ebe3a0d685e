"""Every named query against its SQL, and the entry points."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_points  # noqa: E402
from check_queries import TABLES, table  # noqa: E402
from shelfmark.plans.registry import load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = {n: q.sql for n, q in load_all().items() if q.sql}
# the library's own; an optional subpackage tests its queries itself
QUERIES = {n: q.run for n, q in load_all().items()}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, cur.fetchall())


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() == 1


def test_no_query_hides_behind_missing_sql():
    assert set(QUERIES) - set(SQL) == {
        "fuzzy_names_ratio", "fuzzy_groups", "rf_train_predict", "soft_vote", "cascade_predict", "predict_with_all"}
