"""Every query against its SQL over the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
from dossier.operators import spread  # noqa: E402
from dossier.plans.table_queries import QUERIES  # noqa: E402
from dossier.plans.table_sql import SQL  # noqa: E402
from tools.compare import TABLES, plain  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def check(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    check(spark, con, name)


@pytest.mark.parametrize("name", [
    "eval_confusion", "folder_match", "duplicate_names", "match_cascade", "match_two_tier",
    "intersection_match", "file_inventory", "image_batches", "running_position",
])
def test_paths_for_large_tables_equal_sql(spark, con, name, monkeypatch):
    """Nothing is broadcast and every group is numbered in ranges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(spread.numbered, "__defaults__", ("position", 0))
    monkeypatch.setattr(spread.listed_in_parts, "__defaults__", ("items", spread.PART_SIZE, None, 0))
    try:
        check(spark, con, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_are_read_once_and_building_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "no job while the query is built")
    df = QUERIES["eval_matched_rows"](spark, SMALL)
    started = tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_returnflag") and sum("FileScan" in x and "l_returnflag" in x for x in plan.splitlines()) == 1
    # Reading a file's schema may start a job; nothing else does.
    assert len(started) <= 2


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3
