"""Runs kept as headers and forecast rows: orders stand in for runs, their line items for forecast rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import labels
from chronoloom.plans import training
from chronoloom.queries import forecasts
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query
from chronoloom.queries.runs import MODEL, runs_table
from chronoloom.session import scratch_path
from chronoloom.sources.runs import RunStore

SPEC = P.WIDE.but(targets=("pm10", "pm2_5"), drivers=("temperature",))

STORED = f"""heads AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey AS user_id, o_orderkey AS k, o_totalprice AS avg_aqi,
    CAST(o_orderdate AS DATE) AS d, {MODEL} AS model_used FROM orders),
  rows AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, CAST(l_quantity AS DOUBLE) AS pm10_pred, CAST(l_extendedprice AS DOUBLE) / 1000 AS pm2_5_pred,
    CAST(l_quantity AS DOUBLE) + l_linenumber AS pm10_actual,
    CASE WHEN l_linenumber < 6 THEN CAST(l_extendedprice AS DOUBLE) / 1000 * (1 - CAST(l_discount AS DOUBLE)) END AS pm2_5_actual FROM lineitem),
  stored AS (SELECT * FROM rows JOIN heads USING (run_id))"""


def item_rows(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("double") / 1000
    rows = P.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
        F.col("l_quantity").cast("double").alias("pm10_pred"),
        price.alias("pm2_5_pred"),
        F.col("l_tax").cast("double").alias("temperature_used"),
        (F.col("l_quantity").cast("double") + F.col("l_linenumber")).alias("pm10_actual"),
        F.when(F.col("l_linenumber") < 6, price * (1 - F.col("l_discount").cast("double"))).alias("pm2_5_actual"),
    )
    return labels.with_safety_band(rows)


def stored_orders(spark: SparkSession, sf: str) -> RunStore:
    store = RunStore(spark, scratch_path(spark, "runs"), SPEC)
    heads = runs_table(spark, sf).drop("results")
    # Line items of orders that are not there would have no run.
    store.append(heads, item_rows(spark, sf).join(heads.select("run_id"), "run_id", "left_semi"))
    return store


SCORED = " UNION ALL ".join(
    f"""SELECT model_used, '{t}' AS target, count(*) AS n, {S.r(f'avg(abs({t}_actual - {t}_pred))', 'mae', 3)},
    {S.r(f'sqrt(avg(({t}_actual - {t}_pred) ** 2))', 'rmse', 3)} FROM stored WHERE {t}_actual IS NOT NULL GROUP BY 1"""
    for t in SPEC.targets
)


@query(f"WITH {STORED} {SCORED}")
def run_store_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Errors by model over all stored forecast rows, without a look into a payload."""
    scored = training.evaluate(stored_orders(spark, sf).view().forecast_rows(), SPEC, ("model_used",))
    return P.settled(scored.select("model_used", "target", "n", "mae", "rmse"), ["mae", "rmse"], 3)


@query(
    f"""WITH {STORED} SELECT user_id, model_used, {forecasts.BAND.replace('{c}', 'pm2_5_pred')} AS pm25_safety_level, count(*) AS n,
    count(DISTINCT run_id) AS runs, {S.r('avg(pm2_5_pred)', 'mean_pm2_5_pred')} FROM stored GROUP BY ALL"""
)
def run_store_bands(spark: SparkSession, sf: str) -> DataFrame:
    """How often each user's runs forecast each safety band, and the mean forecast there."""
    rows = stored_orders(spark, sf).view().forecast_rows()
    out = rows.groupBy("user_id", "model_used", "pm25_safety_level").agg(
        F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.avg("pm2_5_pred").alias("mean_pm2_5_pred")
    )
    return P.settled(out, ["mean_pm2_5_pred"])


@query(
    f"""WITH {STORED}, lines AS (SELECT run_id, count(*) AS n, avg(pm2_5_pred) AS m FROM rows GROUP BY 1)
    SELECT heads.run_id, user_id, coalesce(n, 0) AS n, {S.r('m', 'mean_pm2_5_pred')} FROM heads LEFT JOIN lines ON heads.run_id = lines.run_id
    WHERE d BETWEEN DATE '1996-01-15' AND DATE '1996-09-20' AND model_used = 'XGBoost'"""
)
def run_store_range(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one model in a range of dates with the mean of their forecast rows; other months are not read."""
    asked = {"start_date": "1996-01-15", "end_date": "1996-09-20", "model_used": "XGBoost"}
    view = stored_orders(spark, sf).view()
    lines = view.forecast_rows(**asked).groupBy("run_id").agg(F.count("*").alias("n"), F.avg("pm2_5_pred").alias("mean_pm2_5_pred"))
    out = view.runs(**asked).select("run_id", "user_id").join(lines, "run_id", "left").fillna(0, ["n"])
    return P.settled(out, ["mean_pm2_5_pred"])


IN_DEBT = "user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query(
    f"""WITH {STORED}, seen AS (SELECT 'appended' AS reader, * FROM heads
      UNION ALL SELECT 'run deleted', * FROM heads WHERE k % 7 <> 0
      UNION ALL SELECT unnest(['user deleted', 'compacted']), * FROM heads WHERE k % 7 <> 0 AND NOT {IN_DEBT}),
    lines AS (SELECT run_id, count(*) AS n FROM rows GROUP BY 1)
    SELECT reader, user_id, count(*) AS runs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n, {S.r('sum(avg_aqi)', 'total', 2)}
    FROM seen LEFT JOIN lines ON lines.run_id = seen.run_id GROUP BY ALL"""
)
def run_store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs and rows by user as four readers see them, each opened before the next change of the store."""
    store = stored_orders(spark, sf)
    views = {"appended": store.view()}
    runs = runs_table(spark, sf)
    foreign = runs.filter("inserted_seq % 11 = 0").select((F.col("user_id") + 10_000_000).alias("user_id"), "run_id")
    store.delete_runs(runs.filter("inserted_seq % 7 = 0").select("user_id", "run_id").unionByName(foreign))
    views["run deleted"] = store.view()
    store.delete_users(P.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))
    views["user deleted"] = store.view()
    store.compact()
    views["compacted"] = store.view()
    out = None
    for reader, view in views.items():
        lines = view.forecast_rows().groupBy("run_id").agg(F.count("*").alias("n"))
        seen = view.runs().join(lines, "run_id", "left").groupBy("user_id").agg(
            F.count("*").alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("avg_aqi").cast("double")).alias("total")
        )
        named = seen.select(F.lit(reader).alias("reader"), "user_id", "runs", "n", "total")
        out = named if out is None else out.unionByName(named)
    return P.settled(out, ["total"], 2)


@query(
    f"""WITH out AS ({forecasts.NAIVE_OUT}), b AS (SELECT * FROM out) """
    + " UNION ALL ".join(
        f"""SELECT series_id AS run_id, model_name AS model_used, forecast_horizon, '{t}' AS target, count(*) AS n,
        {S.r(f'avg(abs({t}_actual - {t}_pred))', 'mae', 3)} FROM b WHERE {t}_actual IS NOT NULL GROUP BY 1, 2, 3"""
        for t in S.TARGETS
    )
)
def run_store_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast of every series kept as a run and scored from its stored rows against what was observed."""
    panel, rows = forecasts._naive_rows(spark, sf, 24)
    rows = forecasts._with_station_actuals(spark, sf, rows).withColumn("run_id", F.col("series_id"))
    heads = rows.groupBy("run_id").agg(
        F.first("model_name").alias("model_used"), F.first("forecast_horizon").alias("forecast_horizon"), F.avg("pm2_5_pred").alias("avg_aqi")
    )
    heads = heads.withColumns({"user_id": F.lit(1).cast("bigint"), "dataset_name": F.col("run_id")})
    store = RunStore(spark, scratch_path(spark, "runs"), P.WIDE)
    store.append(heads, rows)
    scored = training.evaluate(store.view().forecast_rows(), P.WIDE, ("run_id", "model_used", "forecast_horizon"))
    return P.settled(scored.select("run_id", "model_used", "forecast_horizon", "target", "n", "mae"), ["mae"], 3)
