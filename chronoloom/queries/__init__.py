"""Registered queries over the provided tables, and equal SQL for checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.queries import checks, features, forecasts, runs, statistics, stored_runs  # noqa: F401 - they register
from chronoloom.queries.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel to filled values with calendar features, averaged by hour of day."""
    from chronoloom.functions import calendar
    from chronoloom.operators import fill, stats
    from chronoloom.queries import panels as P

    panel = fill.fill_limited(P.event_type_hours(spark, sf_dir), P.SINGLE, ["y"])
    features_ = calendar.with_calendar(panel, P.SINGLE)
    cols = ["y", *P.SINGLE.calendar]
    return stats.seasonal_hour(features_, "time", cols, ("series_id",))
