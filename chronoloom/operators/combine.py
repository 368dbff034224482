"""Unions and joins of panel frames (G, H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import coerce
from chronoloom.operators import schema, windows
from chronoloom.spec import PanelSpec, PanelValidationError

# Source tags, lowest priority first.
SOURCES = ("uploaded", "live_api")


def combine_sources(
    uploaded: DataFrame | None,
    live: DataFrame | None,
    spec: PanelSpec,
    arrival: str | None = None,
) -> DataFrame:
    """Union of both sources, one row per series and time, the live row winning.

    Inside one source the row with the greatest ``arrival`` value wins; rows
    still equal in rank are decided by their values, so a rerun gives the same
    rows.
    """
    frames = []
    for priority, (df, tag) in enumerate(zip((uploaded, live), SOURCES)):
        if df is None:
            continue
        arrived = F.col(arrival).cast("bigint") if arrival in df.columns else F.lit(0).cast("bigint")
        ranked = df.withColumns({"_arrived": arrived, "_priority": F.lit(priority)})
        frames.append(schema.expected_schema(ranked, spec, tag, also=("_priority", "_arrived")))
    if not frames:
        raise PanelValidationError("There is no source data to combine.")
    union = reduce(DataFrame.unionByName, frames)
    timed = coerce.drop_unreadable_times(coerce.parse_time_lenient(union, spec), spec)
    best = windows.latest_per_time(timed, spec, ["_priority", "_arrived", *spec.targets, "city"])
    return best.drop("_priority", "_arrived")


def with_actuals(forecast: DataFrame, actuals: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach ``<target>_actual`` to forecast rows of the same series and hour (G1)."""
    named = actuals.select(
        spec.key, spec.time, *[F.col(t).alias(f"{t}_actual") for t in spec.targets]
    )
    return forecast.join(named, [spec.key, spec.time], "left")


def side_by_side(frames: list[DataFrame], spec: PanelSpec) -> DataFrame:
    """Predictions, actuals and drivers of the same hours in one row."""
    return reduce(lambda a, b: a.join(b, [spec.key, spec.time]), frames)


def without_series(df: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """Rows of series that are not listed in ``bad``."""
    return df.join(bad.select(key).distinct(), key, "left_anti")


def only_series(df: DataFrame, good: DataFrame, key: str) -> DataFrame:
    return df.join(good.select(key).distinct(), key, "left_semi")
