"""Shaping, coercion, filling, lags, splits and windows over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import calendar, coerce, labels
from chronoloom.operators import combine, fill, schema, stats, windows
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query

KEYS = ("series_id", "time")


@query(f"WITH {S.TYPE_PANEL} SELECT series_id, time, {', '.join(S.r(e, n, 6) for n, e in S.calendar())} FROM panel")
def time_features(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.event_type_hours(spark, sf).drop("y")
    return P.settled(calendar.with_calendar(panel, P.SINGLE), P.SINGLE.calendar, 6)


@query(f"WITH {S.TYPE_PANEL} SELECT series_id, CAST(month(time) AS INTEGER) AS month, {S.r('avg(y)', 'y')} FROM panel GROUP BY 1, 2")
def seasonal_month(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.seasonal_month(P.event_type_hours(spark, sf), "time", ["y"], ("series_id",)), ["y"])


@query(f"WITH {S.TYPE_PANEL} SELECT series_id, CAST(hour(time) AS INTEGER) AS hour, {S.r('avg(y)', 'y')} FROM panel GROUP BY 1, 2")
def seasonal_hour(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.seasonal_hour(P.event_type_hours(spark, sf), "time", ["y"], ("series_id",)), ["y"])


@query(
    "SELECT o_orderpriority AS series_id, o_orderdate AS time, 0.0::DOUBLE AS pm10, o_totalprice AS pm2_5, "
    "0.0::DOUBLE AS carbon_monoxide, 0.0::DOUBLE AS nitrogen_dioxide, 0.0::DOUBLE AS sulphur_dioxide, "
    "0.0::DOUBLE AS ozone, o_orderpriority AS city, 'uploaded' AS source FROM orders"
)
def expected_schema(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias(" Time"),
        F.col("o_totalprice").alias("PM2_5"),
        F.col("o_orderpriority").alias("City "),
        F.col("o_orderkey").alias("note"),
    )
    return schema.expected_schema(raw, P.WIDE)


NUMBER_TEXT = """CASE event_id % 9
  WHEN 0 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '-1e3'
  WHEN 3 THEN '  ' || CAST(user_id AS VARCHAR) || ' ' WHEN 4 THEN '1d' WHEN 5 THEN 'NaN'
  WHEN 6 THEN '' WHEN 7 THEN '.' || CAST(user_id AS VARCHAR) ELSE '1,5' END"""


@query(
    f"""SELECT event_id, CASE WHEN regexp_full_match(t, '\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')
        THEN TRY_CAST(trim(t) AS DOUBLE) END AS number
        FROM (SELECT event_id, {NUMBER_TEXT} AS t FROM events)"""
)
def numeric_coerce(spark: SparkSession, sf: str) -> DataFrame:
    texts = P.table(spark, sf, "events").select(
        "event_id", F.expr(NUMBER_TEXT.replace("VARCHAR", "STRING")).alias("number")
    )
    return coerce.numeric(texts, ["number"])


def _time_texts(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    kind = F.col("event_id") % 8
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 4, F.date_format(ts, "MM/dd/yyyy HH:mm"))
        .when(kind == 5, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 6, F.date_format(ts, "HH:mm"))
        .otherwise(F.lit("not-a-date"))
    )
    return P.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("series_id"), text.alias("time")
    )


PARSED = """CASE event_id % 8
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
  WHEN 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 4 THEN date_trunc('minute', ts)
  WHEN 5 THEN date_trunc('second', ts) END"""


@query(f"SELECT event_id, event_type AS series_id, {PARSED} AS time FROM events")
def time_parse(spark: SparkSession, sf: str) -> DataFrame:
    return coerce.parse_time_lenient(_time_texts(spark, sf), P.SINGLE)


@query(
    f"""WITH first AS (SELECT event_type AS series_id, min_by(event_id % 8, event_id) AS kind FROM events GROUP BY 1)
    SELECT event_id, f.series_id, CASE WHEN event_id % 8 = f.kind OR f.kind IN (6, 7) THEN {PARSED} END AS time
    FROM events e JOIN first f ON f.series_id = e.event_type"""
)
def time_parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    return coerce.parse_time_strict(_time_texts(spark, sf), P.SINGLE, order="event_id")


@query(
    f"WITH {S.STATION_PANEL} SELECT series_id, time, {S.r('pm10', 'pm10')}, {S.r('pm2_5', 'pm2_5')}, "
    "0.0::DOUBLE AS carbon_monoxide, 0.0::DOUBLE AS nitrogen_dioxide, 0.0::DOUBLE AS sulphur_dioxide, "
    "0.0::DOUBLE AS ozone, temperature, wind_speed FROM panel"
)
def align_features(spark: SparkSession, sf: str) -> DataFrame:
    part = P.station_panel(spark, sf).select("wind_speed", "time", "pm2_5", "pm10", "temperature", "series_id")
    return P.settled(schema.align(part, P.WIDE.measured, KEYS), ["pm10", "pm2_5"])


@query(
    f"""WITH {S.STATION_PANEL} SELECT series_id, time, pm2_5,
    CASE WHEN pm2_5 IS NULL THEN 'High' WHEN pm2_5 <= 12.0 THEN 'Low' WHEN pm2_5 <= 35.4 THEN 'Moderate'
    ELSE 'High' END AS pm25_safety_level FROM panel"""
)
def safety_band(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.station_panel(spark, sf).select(*KEYS, "pm2_5")
    return labels.with_safety_band(panel, "pm2_5")


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"raw":"broken ' || event_type || '"}' ELSE props END AS results
    FROM events"""
)
def readable_json(spark: SparkSession, sf: str) -> DataFrame:
    stored = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("broken "), "event_type")).otherwise(F.col("props"))
    return P.table(spark, sf, "events").select("event_id", labels.readable_json(stored).alias("results"))


@query(
    "SELECT doc_id, concat_ws(':', source || '/' || doc_id, CAST(strlen(text) AS VARCHAR), md5(text)) AS signature FROM documents"
)
def upload_signature(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", labels.content_signature(name, F.col("text")).alias("signature"))


ORDER_DAYS = S.on_spine(
    "SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS time, avg(o_totalprice) AS y "
    "FROM orders GROUP BY 1, 2",
    "o.y",
    "1 DAY",
)


@query(f"WITH {ORDER_DAYS} SELECT series_id, time, {S.r('y', 'y')} FROM panel")
def daily_resample(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(fill.resample_daily(P.order_events(spark, sf), P.SINGLE, ["y"]), ["y"])


@query(
    f"""WITH {ORDER_DAYS}, near AS (SELECT *, {S.SECONDS} AS sec, {S.neighbours(['y'], S.SECONDS)} FROM panel)
    SELECT series_id, time, {S.r(S.filled('y', S.line('y', 'sec')), 'y')} FROM near"""
)
def daily_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    daily = fill.resample_daily(P.order_events(spark, sf), P.SINGLE, ["y"])
    return P.settled(fill.fill_time(daily, P.SINGLE.daily(), ["y"]), ["y"])


def _limited_sql(panel: str) -> str:
    return f"""WITH {panel}, near AS (SELECT *, {S.SECONDS} AS sec, {S.neighbours(['y'], S.SECONDS)} FROM panel)
    SELECT series_id, time, {S.r(S.limited('y'), 'y')} FROM near"""


@query(_limited_sql(S.USER_PANEL))
def limited_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(fill.fill_limited(P.user_hours(spark, sf), P.SINGLE, ["y"]), ["y"])


@query(_limited_sql(S.TYPE_PANEL))
def limited_gap_fill_dense(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(fill.fill_limited(P.event_type_hours(spark, sf), P.SINGLE, ["y"]), ["y"])


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    """Observed hours of every user, a third of them without a value."""
    return P.event_hours(spark, sf, "user_id").withColumn("y", F.when(F.hour("time") % 3 != 0, F.col("y")))


HOLED = f"""obs AS ({S.event_hours('user_id')}),
  panel AS (SELECT series_id, time, CASE WHEN hour(time) % 3 <> 0 THEN y END AS y,
            row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS pos FROM obs)"""


@query(
    f"""WITH {HOLED}, near AS (SELECT *, {S.neighbours(['y'], 'pos')} FROM panel)
    SELECT series_id, time, {S.r(S.filled('y', S.line('y', 'pos')), 'y')} FROM near"""
)
def linear_fill(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(fill.fill_linear(_holed(spark, sf), P.SINGLE, ["y"]), ["y"])


@query(
    f"""WITH {HOLED}, near AS (SELECT *, {S.neighbours(['y'], 'pos')} FROM panel)
    SELECT series_id, time, {S.r('coalesce(pv_y, nv_y)', 'y')} FROM near"""
)
def carry_fill(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(fill.fill_carry(_holed(spark, sf), P.SINGLE, ["y"]), ["y"])


LAGGED = {"pm2_5_lag1": ("pm2_5", 1), "pm2_5_lag2": ("pm2_5", 2), "pm10_lag1": ("pm10", 1),
          "nitrogen_dioxide_lag1": ("nitrogen_dioxide", 1), "ozone_lag1": ("ozone", 1)}
LAG_SQL = ", ".join(
    f"lag({c}, {n}) OVER (PARTITION BY series_id ORDER BY time) AS {name}" for name, (c, n) in LAGGED.items()
)


@query(
    f"""WITH {S.STATION_PANEL}, lagged AS (SELECT series_id, time, {', '.join(S.TARGETS)}, {LAG_SQL} FROM panel)
    SELECT series_id, time, {S.rs(S.TARGETS + list(LAGGED))} FROM lagged
    WHERE {' AND '.join(f'{c} IS NOT NULL' for c in S.TARGETS + list(LAGGED))}"""
)
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    panel = P.station_panel(spark, sf).select(*KEYS, *S.TARGETS)
    return P.settled(windows.lag_features(panel, P.WIDE), S.TARGETS + list(LAGGED))


@query(
    f"""WITH {ORDER_DAYS} SELECT series_id, time, CASE WHEN row_number() OVER
    (PARTITION BY series_id ORDER BY time DESC) <= 7 THEN 'test' ELSE 'train' END AS split FROM panel"""
)
def holdout_last_n(spark: SparkSession, sf: str) -> DataFrame:
    daily = fill.resample_daily(P.order_events(spark, sf), P.SINGLE, ["y"])
    return windows.holdout_last(daily, P.SINGLE.daily(), 7).select(*KEYS, "split")


@query(
    f"""WITH obs AS ({S.event_hours('user_id')}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS pos,
               count(*) OVER (PARTITION BY series_id) AS n FROM obs)
    SELECT series_id, time, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed"""
)
def split_80_20(spark: SparkSession, sf: str) -> DataFrame:
    return windows.split_fraction(P.event_hours(spark, sf, "user_id"), P.SINGLE).select(*KEYS, "split")


def _windows_sql(horizon: int) -> str:
    return f"""WITH {S.STATION_PANEL}, kept AS (SELECT * FROM panel WHERE pm10 IS NOT NULL AND pm2_5 IS NOT NULL),
    built AS (SELECT series_id, lead(time, {horizon - 1}) OVER w AS time,
      list(pm10) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS a,
      list(pm2_5) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS b,
      lead(pm2_5, {horizon - 1}) OVER w AS y FROM kept WINDOW w AS (PARTITION BY series_id ORDER BY time))
    SELECT series_id, time, {S.r('a[1]', 'oldest')}, {S.r('b[48]', 'newest')},
      {S.r('list_sum(list_transform(range(1, 49), lambda i: i * a[i] + 100 * i * b[i]))', 'weighted', 2)},
      {S.r('y', 'y')}
    FROM built WHERE len(a) = 48 AND y IS NOT NULL"""


def _window_frame(spark: SparkSession, sf: str, horizon: int) -> DataFrame:
    kept = P.station_panel(spark, sf).select(*KEYS, "pm10", "pm2_5").na.drop("any")
    return windows.sliding_windows(kept, P.WIDE, ["pm10", "pm2_5"], ["pm2_5"], horizon=horizon)


@query(_windows_sql(1))
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _window_digest(_window_frame(spark, sf, 1))


@query(_windows_sql(24))
def sliding_windows_ahead(spark: SparkSession, sf: str) -> DataFrame:
    return _window_digest(_window_frame(spark, sf, 24))


def _window_digest(built: DataFrame) -> DataFrame:
    """A few numbers per window that depend on every value and its place."""
    placed = F.transform("window", lambda row, i: (i + 1) * row[0] + 100 * (i + 1) * row[1])
    total = F.aggregate(placed, F.lit(0.0), lambda acc, v: acc + v)
    out = built.select(
        *KEYS,
        F.col("window")[0][0].alias("oldest"),
        F.element_at("window", -1)[1].alias("newest"),
        total.alias("weighted"),
        F.col("y")[0].alias("y"),
    )
    return P.settled(P.settled(out, ["oldest", "newest", "y"]), ["weighted"], 2)


@query(
    f"""WITH {S.STATION_PANEL}, kept AS (SELECT * FROM panel WHERE pm10 IS NOT NULL AND pm2_5 IS NOT NULL),
    built AS (SELECT series_id, time, list(pm10) OVER w AS a, list(pm2_5) OVER w AS b FROM kept
      WINDOW w AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
    SELECT series_id, time, CAST(2 * len(a) AS INTEGER) AS width, {S.r('a[1]', 'f0')}, {S.r('b[1]', 'f1')},
      {S.r('a[25]', 'f48')}, {S.r('b[48]', 'f95')} FROM built WHERE len(a) = 48"""
)
def flatten_windows(spark: SparkSession, sf: str) -> DataFrame:
    flat = windows.flatten_windows(_window_frame(spark, sf, 1))
    picks = {f"f{i}": F.col("features")[i] for i in (0, 1, 48, 95)}
    out = flat.select(*KEYS, F.size("features").alias("width"), *[c.alias(n) for n, c in picks.items()])
    return P.settled(out, list(picks))


@query(
    f"""WITH obs AS ({S.event_hours('user_id')}), ranked AS (SELECT *,
      row_number() OVER (PARTITION BY series_id ORDER BY time) AS up,
      row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS down FROM obs)
    SELECT series_id, time, 'head' AS part, {S.r('y', 'y')} FROM ranked WHERE up <= 24
    UNION ALL SELECT series_id, time, 'tail' AS part, {S.r('y', 'y')} FROM ranked WHERE down <= 48"""
)
def tail_head(spark: SparkSession, sf: str) -> DataFrame:
    hours = P.event_hours(spark, sf, "user_id")
    head = windows.oldest_rows(hours, P.SINGLE, 24).withColumn("part", F.lit("head"))
    tail = windows.newest_rows(hours, P.SINGLE, 48).withColumn("part", F.lit("tail"))
    return P.settled(head.unionByName(tail), ["y"])


@query(
    """WITH rows AS (
      SELECT event_type AS series_id, date_trunc('hour', ts) AS time, value AS pm2_5, event_type AS city,
             CASE WHEN event_id % 4 = 0 THEN 'live_api' ELSE 'uploaded' END AS source,
             CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS priority, event_id FROM events),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, time ORDER BY priority DESC, event_id DESC) AS rn FROM rows)
    SELECT series_id, time, 0.0::DOUBLE AS pm10, pm2_5, 0.0::DOUBLE AS carbon_monoxide, 0.0::DOUBLE AS nitrogen_dioxide,
      0.0::DOUBLE AS sulphur_dioxide, 0.0::DOUBLE AS ozone, city, source FROM ranked WHERE rn = 1"""
)
def combine_sources(spark: SparkSession, sf: str) -> DataFrame:
    events = P.table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("city"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        F.col("value").alias("pm2_5"),
    )
    live = events.filter("event_id % 4 = 0")
    uploaded = events.filter("event_id % 4 <> 0")
    return combine.combine_sources(uploaded, live, P.WIDE, arrival="event_id")


@query(
    f"""WITH obs AS ({S.event_hours('user_id')}), stepped AS (SELECT series_id, time,
      lag(time) OVER (PARTITION BY series_id ORDER BY time) AS previous FROM obs)
    SELECT series_id, time, previous, (epoch(time) - epoch(previous)) / 3600.0 AS step_hours FROM stepped"""
)
def time_diff(spark: SparkSession, sf: str) -> DataFrame:
    hours = P.event_hours(spark, sf, "user_id").select(*KEYS)
    return windows.time_steps(hours, P.SINGLE)


@query("SELECT event_id, user_id, value FROM events")
def numeric_only(spark: SparkSession, sf: str) -> DataFrame:
    """The numeric columns of a table."""
    return schema.keep_numeric(P.table(spark, sf, "events"))


@query(
    f"WITH {S.STATION_PANEL} SELECT series_id, time, {S.rs(['ozone', 'temperature'])}, CAST(NULL AS DOUBLE) AS humidity FROM panel"
)
def reindexed(spark: SparkSession, sf: str) -> DataFrame:
    """Listed columns in order, one of them absent."""
    listed = schema.reindex(P.station_panel(spark, sf), ("humidity", "ozone", "temperature"), ("series_id", "time"))
    return P.settled(listed, ["ozone", "temperature"])


@query(
    """SELECT o_orderpriority AS series_id, o_orderdate AS time, o_totalprice AS y FROM orders
    WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 2"""
)
def month_slice(spark: SparkSession, sf: str) -> DataFrame:
    """One calendar month of one year."""
    return schema.calendar_month(P.order_events(spark, sf), P.SINGLE, 1996, 2)
