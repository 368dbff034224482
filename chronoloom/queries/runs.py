"""History and settings tables: orders stand in for forecast runs, customers for users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans import history
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query
from chronoloom.session import scratch_path
from chronoloom.sources import csv
from chronoloom.sources.history import HistoryStore

MODEL = "CASE WHEN o_orderkey % 3 = 0 THEN 'XGBoost' ELSE 'LSTM' END"

RUNS = f"""runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey AS user_id,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, {MODEL} AS model_used,
    CASE WHEN o_orderkey % 5 = 0 THEN '{{"raw":"' || o_orderstatus || ' broken"}}' ELSE '{{"status":"' || o_orderstatus || '"}}' END AS results,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:30:00+00:00' END AS upload_date,
    o_totalprice AS avg_aqi, o_orderkey AS inserted_seq, CAST(o_orderdate AS DATE) AS d FROM orders)"""
SHOWN = "run_id, user_id, timestamp, model_used, results, upload_date, avg_aqi, inserted_seq"


def runs_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = P.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("date").cast("string")
    good = F.concat(F.lit('{"status":"'), status, F.lit('"}'))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.translate(F.col("o_orderdate").cast("string"), " ", "T"), F.lit("+00:00")).alias("timestamp"),
        F.expr(MODEL).alias("model_used"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(status, F.lit(" broken"))).otherwise(good).alias("results"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("T12:30:00+00:00"))).alias("upload_date"),
        F.col("o_totalprice").alias("avg_aqi"),
        F.col("o_orderkey").alias("inserted_seq"),
    )


@query(
    f"""WITH {RUNS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY inserted_seq DESC) AS rn FROM runs)
    SELECT {SHOWN} FROM ranked WHERE rn <= 5"""
)
def history_recent(spark: SparkSession, sf: str) -> DataFrame:
    return history.recent_runs(runs_table(spark, sf), limit=5)


@query(
    f"""WITH {RUNS} SELECT {SHOWN.replace('results, ', '')} FROM runs
    WHERE d BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND model_used = 'XGBoost'"""
)
def history_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = history.filtered_runs(
        runs_table(spark, sf), start_date="1996-01-01", end_date="1997-06-30", model_used="XGBoost"
    )
    return found.drop("results")


@query(
    f"WITH {RUNS} SELECT run_id, user_id, substr(coalesce(upload_date, timestamp), 1, 16) AS date, model_used AS model FROM runs"
)
def history_list(spark: SparkSession, sf: str) -> DataFrame:
    return history.by_date(history.run_list(runs_table(spark, sf)))


@query(f"WITH {RUNS} SELECT run_id, user_id, model_used FROM runs WHERE inserted_seq % 7 <> 0")
def history_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh run is deleted by its owner; every eleventh by somebody else, without effect."""
    runs = runs_table(spark, sf)
    own = runs.filter("inserted_seq % 7 = 0").select("user_id", "run_id")
    foreign = runs.filter("inserted_seq % 11 = 0").select((F.col("user_id") + 10_000_000).alias("user_id"), "run_id")
    return history.without_deleted(runs, own.unionByName(foreign)).select("run_id", "user_id", "model_used")


@query(
    f"""WITH {RUNS} SELECT run_id, user_id, model_used FROM runs
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt lose their account, and their runs go with it."""
    gone = P.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return history.without_users(runs_table(spark, sf), gone).select("run_id", "user_id", "model_used")


SETTING = "CASE o_orderkey % 4 WHEN 0 THEN 'ARIMA' WHEN 1 THEN 'XGBoost' WHEN 2 THEN 'LSTM' ELSE 'Prophet' END"
CLEAN = "CASE o_orderkey % 4 WHEN 1 THEN 'XGBoost' ELSE 'LSTM' END"
LATEST = f"""SELECT o_custkey AS user_id,
    max_by({CLEAN}, (epoch(o_orderdate) * 2 + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END)) AS default_model,
    max(o_orderdate) AS updated_at FROM orders GROUP BY 1"""


def settings_writes(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.expr(SETTING).alias("default_model"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("theme"),
    )


@query(LATEST)
def settings_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All writes replayed: old ones as the stored table, the rest as changes."""
    writes = settings_writes(spark, sf).drop("theme")
    old = history.latest_settings(history.normalised_settings(writes.filter("updated_at < '1998-01-01'")))
    return history.upsert_settings(old, writes.filter("updated_at >= '1998-01-01'"))


@query(
    f"""WITH latest AS ({LATEST})
    SELECT c_custkey AS user_id, coalesce(default_model, 'LSTM') AS default_model
    FROM customer LEFT JOIN latest ON user_id = c_custkey"""
)
def settings_default(spark: SparkSession, sf: str) -> DataFrame:
    users = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    stored = history.latest_settings(history.normalised_settings(settings_writes(spark, sf).drop("theme")))
    return history.settings_of(users, stored)


@query(
    f"""SELECT o_custkey AS user_id, CASE WHEN {SETTING} = 'ARIMA' THEN 'LSTM' ELSE {SETTING} END AS default_model,
    o_orderdate AS updated_at FROM orders"""
)
def settings_migrate(spark: SparkSession, sf: str) -> DataFrame:
    return history.migrated_settings(settings_writes(spark, sf))


@query(
    f"""WITH {RUNS} SELECT {SHOWN.replace('results, ', '')} FROM runs
    WHERE inserted_seq % 7 <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def history_store(spark: SparkSession, sf: str) -> DataFrame:
    """Runs appended to a stored history, some deleted, users in debt removed, then read back."""
    store = HistoryStore(spark, scratch_path(spark, "history"))
    runs = runs_table(spark, sf)
    store.append_runs(runs)
    store.delete_runs(runs.filter("inserted_seq % 7 = 0"))
    gone = P.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    left = history.without_users(store.runs(), gone)
    return left.select(*[c for c in runs.columns if c != "results"])


@query(f"SELECT series_id, time, {S.r('y', 'y')} FROM ({S.event_hours('event_type')})")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means written as CSV and read back as a typed panel."""
    path = scratch_path(spark, "csv")
    csv.write_csv(P.event_hours(spark, sf, "event_type"), path)
    return P.settled(csv.read_panel_csv(spark, path, P.SINGLE), ["y"])


FILED = P.WIDE.but(targets=("pm10",), drivers=("temperature",))
DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderkey % 2 = 0 AS stored,
    CASE WHEN o_orderkey % 2 = 0 THEN 'time,pm10' || chr(10) || {DAY} || ',' || o_custkey || chr(10)
      ELSE 'time,pm10,temperature' || chr(10) || {DAY} || 'T00,' || o_custkey || '.5,' || chr(10)
        || {DAY} || 'T01,,' || o_orderkey || '.25' || chr(10) END AS content
    FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 <> 0"""
)
def stored_or_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The uploaded file of each run: as stored for every second one, else rebuilt from the payload, where that is JSON."""
    orders = P.table(spark, sf, "orders")
    day, key, user = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    past = F.format_string(
        '{"history":[{"time":"%sT01","temperature":%s.25},{"time":"%sT00","pm10":%s.5}]}', day, key, day, user
    )
    runs = orders.select(
        key.alias("run_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "no payload").otherwise(past).alias("results"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("time,pm10\n"), day, F.lit(","), user, F.lit("\n")).cast("binary")).alias("dataset_csv"),
    )
    return history.run_files(runs, FILED, "history")
