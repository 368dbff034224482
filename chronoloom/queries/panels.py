"""Panels built from the provided tables.

``event_type_hours`` is a dense panel (few gaps), ``user_hours`` a sparse one
(gaps of up to several days), ``station_panel`` a wide one with the column names
of the air-quality preset, ``order_days`` a daily one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.operators import blocks
from chronoloom.spec import AIR_QUALITY, PanelSpec

SINGLE = PanelSpec(targets=("y",), drivers=())
WIDE = AIR_QUALITY
FUTURE_HOURS = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_spine(observed: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every hour between the first and last of a series, unobserved ones with NULLs."""
    bounds = observed.groupBy(spec.key).agg(
        F.min(spec.time).alias("_first"), F.max(spec.time).alias("_last")
    )
    hours = blocks.spine(bounds, spec, "_first", "_last")
    return blocks.dealt(hours, spec.key, spec.time).join(observed, [spec.key, spec.time], "left")


def event_hours(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Mean event value per series and hour, observed hours only."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col(key).cast("string").alias("series_id"), clock.floor_to(F.col("ts"), 3600).alias("time")
    ).agg(F.avg("value").alias("y"))


def event_type_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_spine(event_hours(spark, sf_dir, "event_type"), SINGLE)


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_spine(event_hours(spark, sf_dir, "user_id"), SINGLE)


def station_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six targets and two drivers per event type and hour; drivers are never missing."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    observed = events.groupBy(
        F.col("event_type").alias("series_id"), clock.floor_to(F.col("ts"), 3600).alias("time")
    ).agg(
        F.avg("value").alias("pm10"),
        F.min("value").alias("pm2_5"),
        F.max("value").alias("carbon_monoxide"),
        F.sum("value").alias("nitrogen_dioxide"),
        F.avg(k).alias("sulphur_dioxide"),
        F.max(k).alias("ozone"),
        F.count("*").cast("double").alias("temperature"),
        F.max(F.col("user_id") % 17).cast("double").alias("wind_speed"),
    )
    return _on_spine(observed, WIDE).fillna(0.0, list(WIDE.drivers))


def upload_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide panel as an upload: text cells, and no targets in the last hours of a series."""
    panel = station_panel(spark, sf_dir)
    last = panel.groupBy("series_id").agg(F.max("time").alias("_last"))
    future = F.col("time") > clock.shift(F.col("_last"), -FUTURE_HOURS * 3600)
    cells = {c: F.when(~future, F.col(c)).cast("string") for c in WIDE.targets}
    return (
        panel.join(last, "series_id")
        .withColumns(cells)
        .withColumns({c: F.col(c).cast("string") for c in WIDE.drivers})
        .withColumns({"time": clock.iso_utc(F.col("time")), "city": F.col("series_id"), "row_order": F.col("time")})
        .drop("_last")
    )


def broken_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with one defect each, by event type: gap, repeated hour, missing future driver, short."""
    panel = upload_text(spark, sf_dir)
    first = panel.groupBy("series_id").agg(F.min("time").alias("_first"), F.max("time").alias("_last"))

    def hours(start: str, end: str) -> F.Column:
        return clock.hours_between(*[F.col(c).cast("timestamp_ntz") for c in (start, end)])

    marked = panel.join(first, "series_id").withColumns(
        {"_hour": hours("_first", "time"), "_left": hours("time", "_last")}
    )
    kind = F.col("series_id")
    kept = marked.filter(~((kind == "click") & F.col("_hour").isin(20, 21, 40))).filter(
        ~((kind == "signup") & (F.col("_left") > 100))
    ).withColumn(
        "temperature",
        F.when((kind == "error") & (F.col("_left") < 7), F.lit("n/a")).otherwise(F.col("temperature")),
    )
    repeated = kept.filter((kind == "purchase") & (F.col("_hour") % 5 == 3))
    return kept.unionByName(repeated).drop("_first", "_last", "_hour", "_left")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values as raw rows of five series."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").alias("time"),
        F.col("o_totalprice").alias("y"),
    )


def lineitem_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )


def settled(df: DataFrame, cols: list[str] | tuple[str, ...], digits: int = 4) -> DataFrame:
    """Round for comparison with an engine that adds in another order.

    The small offset moves exact decimal ties off the rounding edge.
    """
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-7), digits) for c in cols})
