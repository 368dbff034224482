"""Every registered query against its SQL, and the plan shapes that keep hot series apart."""

from __future__ import annotations

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from chronoloom.operators import fill, windows
from chronoloom.plans import history
from chronoloom.queries import panels as P
from chronoloom.queries import runs

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert len(got.columns) > 0
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).fetchdf()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_rows_are_cut_before_the_shuffle(spark):
    hours = P.event_hours(spark, SMALL, "user_id")
    for df in (windows.newest_rows(hours, P.SINGLE, 48), history.recent_runs(runs.runs_table(spark, SMALL), 5)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_rows_of_one_series_are_spread_over_blocks(spark):
    """No exchange moves the rows themselves on the series alone."""
    hours = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_type AS series_id", "ts AS time", "value AS y")
    text = plan(fill.fill_limited(hours, P.SINGLE, ["y"]))
    alone = [line for line in text.split("\n") if "Exchange hashpartitioning(series_id" in line and "_block" not in line]
    assert len(alone) == 1  # the block summaries
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
