"""Validation rules and preparation flows over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.operators import validate
from chronoloom.plans import prepare, recursive, training
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query
from chronoloom.session import durable
from chronoloom.spec import MIN_EXTRA_ROWS


def _raw_hours(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), clock.floor_to(F.col("ts"), 3600).alias("time")
    )


@query(
    """WITH c AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS time, count(*) AS n FROM events GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS rn FROM c WHERE n > 1)
    SELECT series_id, count(*) AS duplicates,
      string_agg(strftime(time, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY time) FILTER (rn <= 3) AS examples
    FROM ranked GROUP BY 1"""
)
def dup_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    found = validate.duplicate_times(validate.time_counts(_raw_hours(spark, sf), P.SINGLE), P.SINGLE)
    shown = F.array_join(F.transform("examples", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ", ")
    return found.withColumn("examples", shown)


@query(
    f"""WITH obs AS ({S.event_hours('user_id')}), stepped AS (SELECT series_id, time,
      lag(time) OVER (PARTITION BY series_id ORDER BY time) AS previous FROM obs),
    bad AS (SELECT *, (epoch(time) - epoch(previous)) / 3600.0 AS h FROM stepped WHERE time - previous <> INTERVAL 1 HOUR)
    SELECT series_id, min(previous) AS gap_start, min(time) AS gap_end, min_by(h, time) AS gap_hours, count(*) AS gaps
    FROM bad GROUP BY 1"""
)
def cadence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    counts = validate.time_counts(P.event_hours(spark, sf, "user_id"), P.SINGLE)
    return validate.cadence_gaps(counts, P.SINGLE)


@query(
    f"""WITH {S.UPLOAD}, {S.cutoffs('upload')}
    SELECT c.series_id, cutoff_ts, (SELECT count(*) FROM upload u WHERE u.series_id = c.series_id AND {S.ALL_KNOWN}) AS observed
    FROM cuts c"""
)
def detect_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    panel = durable(prepare.read_panel(P.upload_text(spark, sf), P.WIDE))
    return validate.detect_cutoff(panel, P.WIDE)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """A wanted cutoff per series: an hour of the data for two of them, a half hour for the rest."""
    first = P.station_panel(spark, sf).groupBy("series_id").agg(F.min("time").alias("_first"))
    offset = F.when(F.col("series_id").isin("click", "view"), F.lit(100 * 3600)).otherwise(F.lit(1800))
    return first.select("series_id", clock.shift(F.col("_first"), offset).alias("cutoff_ts"))


@query(
    f"""WITH {S.STATION_PANEL}, asked AS (SELECT series_id, min(time) + CASE WHEN series_id IN ('click', 'view')
      THEN INTERVAL 100 HOUR ELSE INTERVAL 30 MINUTE END AS cutoff_ts FROM panel GROUP BY 1)
    SELECT series_id, cutoff_ts, EXISTS (SELECT 1 FROM panel p WHERE p.series_id = a.series_id AND p.time = a.cutoff_ts) AS in_data
    FROM asked a"""
)
def explicit_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return validate.explicit_cutoff(P.station_panel(spark, sf), _asked(spark, sf), P.WIDE)


@query(
    f"""WITH obs AS ({S.event_hours('user_id')})
    SELECT series_id, count(*) AS rows, count(*) >= 48 AS enough FROM obs GROUP BY 1"""
)
def min_past_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.enough_rows(P.event_hours(spark, sf, "user_id"), P.SINGLE, P.SINGLE.window)


@query(
    f"""WITH {S.STATION_PANEL}
    SELECT series_id, count(*) FILTER (month(time) = 1) AS history_rows, count(*) FILTER (month(time) = 2) AS target_rows,
      count(*) FILTER (month(time) = 1) >= 48 AND count(*) FILTER (month(time) = 2) > 0 AS usable FROM panel GROUP BY 1"""
)
def months_present(spark: SparkSession, sf: str) -> DataFrame:
    return validate.months_present(P.station_panel(spark, sf), P.WIDE, 2024, 1, 2)


BROKEN = S.UPLOAD + """,
  marked AS (SELECT u.*, (epoch(u.time) - epoch(f.lo)) / 3600 AS hour_no, (epoch(f.hi) - epoch(u.time)) / 3600 AS left_no
             FROM upload u JOIN bounds f ON f.series_id = u.series_id),
  kept AS (SELECT * REPLACE (CASE WHEN series_id = 'error' AND left_no < 7 THEN NULL ELSE temperature END AS temperature)
           FROM marked WHERE NOT (series_id = 'click' AND hour_no IN (20, 21, 40)) AND NOT (series_id = 'signup' AND left_no > 100)),
  broken AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE series_id = 'purchase' AND hour_no % 5 = 3)"""


@query(
    f"""WITH {BROKEN}, {S.cutoffs('broken')},
    bad AS (SELECT b.series_id, b.time, row_number() OVER (PARTITION BY b.series_id ORDER BY b.time) AS rn
            FROM broken b JOIN cuts c ON c.series_id = b.series_id
            WHERE b.time > c.cutoff_ts AND (temperature IS NULL OR wind_speed IS NULL))
    SELECT series_id, count(*) AS bad_hours,
      string_agg(strftime(time, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY time) FILTER (rn <= 5) AS examples
    FROM bad GROUP BY 1"""
)
def future_drivers_check(spark: SparkSession, sf: str) -> DataFrame:
    panel = durable(prepare.read_panel(P.broken_uploads(spark, sf), P.WIDE))
    cuts = validate.detect_cutoff(panel, P.WIDE)
    found = validate.bad_future_times(panel, cuts, P.WIDE)
    shown = F.array_join(F.transform("examples", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), ", ")
    return found.withColumn("examples", shown)


def _failures_sql(last: str = "") -> str:
    return f"""WITH {BROKEN}, {S.cutoffs('broken')},
    steps AS (SELECT series_id, time, lag(time) OVER (PARTITION BY series_id ORDER BY time) AS prev FROM broken),
    per AS (SELECT b.series_id, c.cutoff_ts,
        count(*) FILTER (b.time <= c.cutoff_ts) AS n_past, count(*) FILTER (b.time > c.cutoff_ts) AS n_future,
        count(*) FILTER (b.time > c.cutoff_ts AND (temperature IS NULL OR wind_speed IS NULL)) AS bad
      FROM broken b JOIN cuts c ON c.series_id = b.series_id GROUP BY 1, 2),
    flaw AS (SELECT series_id, bool_or(time = prev) AS dup, bool_or(time - prev <> INTERVAL 1 HOUR AND time <> prev) AS gap
      FROM steps GROUP BY 1)
    SELECT * FROM (SELECT p.series_id, CASE WHEN dup THEN 'duplicate_time' WHEN gap THEN 'broken_cadence'
        WHEN cutoff_ts IS NULL THEN 'no_observed_row' WHEN n_past < 48 THEN 'short_past'
        WHEN n_future = 0 THEN 'no_future_rows' WHEN bad > 0 THEN 'bad_future_drivers' {last} END AS rule
      FROM per p JOIN flaw f ON f.series_id = p.series_id) WHERE rule IS NOT NULL"""


@query(_failures_sql())
def upload_failures(spark: SparkSession, sf: str) -> DataFrame:
    """First broken rule of each rejected upload."""
    prepared = prepare.prepare_upload(P.broken_uploads(spark, sf), P.WIDE, order="row_order")
    return prepared.failures.select("series_id", "rule")


@query(_failures_sql("WHEN n_future < 168 THEN 'short_future'"))
def forecast_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Every series that gets no forecast of a week, with the rule that stopped it."""
    prepared = prepare.prepare_upload(P.broken_uploads(spark, sf), P.WIDE, order="row_order")
    return recursive.refused(prepared, P.WIDE, 168).select("series_id", "rule")


@query(
    """WITH spans AS (SELECT user_id || ':' || ((day(ts) - 1) // 12) AS series_id,
      greatest(date_diff('day', min(ts)::DATE, max(ts)::DATE) - 1, 0) AS rows FROM events GROUP BY 1)
    SELECT * FROM spans WHERE rows <= 7"""
)
def batch_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of 12 days of each user that are too short, after two lags, to hold out a week."""
    stretch = F.floor((F.dayofmonth("ts") - 1) / 12).cast("string")
    events = P.table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), stretch).alias("series_id"),
        F.col("ts").alias("time"),
        F.col("value").alias("pm2_5"),
    )
    return prepare.batch_frames(events, P.WIDE).rejected


@query(
    f"""WITH obs AS ({S.event_hours('user_id')})
    SELECT series_id, count(*) FILTER (y IS NOT NULL) AS rows FROM obs GROUP BY 1
    HAVING count(*) FILTER (y IS NOT NULL) < {P.SINGLE.window + 1 + MIN_EXTRA_ROWS}"""
)
def training_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Users with too few complete rows to train on."""
    return training.too_small(P.event_hours(spark, sf, "user_id"), P.SINGLE)


def _last_day(panel: DataFrame) -> DataFrame:
    """A cutoff one day before the end of each series."""
    return panel.groupBy("series_id").agg(F.max("time").alias("_last")).select(
        "series_id", clock.shift(F.col("_last"), -24 * 3600).alias("cutoff_ts")
    )


@query(
    """SELECT event_type AS series_id, 'unfilled_past' AS rule, 'no value to fill from in: ozone' AS detail
    FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"""
)
def unfilled_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Series whose past has a column without any value; two of them had their ozone taken away."""
    bare = F.col("series_id").isin("click", "view")
    panel = P.station_panel(spark, sf).withColumn("ozone", F.when(~bare, F.col("ozone")))
    summary = validate.cut_summary(panel, _last_day(panel), P.WIDE)
    return validate.past_failures(summary, P.WIDE).select("series_id", "rule", "detail")


@query(
    """SELECT event_type AS series_id, date_trunc('hour', max(ts)) - INTERVAL 24 HOUR AS cutoff_ts,
      date_trunc('hour', max(ts)) - INTERVAL 21 HOUR AS first_future FROM events WHERE event_type = 'click' GROUP BY 1"""
)
def future_start(spark: SparkSession, sf: str) -> DataFrame:
    """Series whose future does not begin one hour after the cutoff; one lost its first two hours."""
    panel = P.station_panel(spark, sf)
    cuts = _last_day(panel)
    late = F.when(F.col("series_id") == "click", F.lit(2 * 3600)).otherwise(F.lit(0))
    start = clock.shift(F.col("cutoff_ts"), late)
    ahead = panel.join(cuts, "series_id").filter(F.col("time") > start).drop("cutoff_ts")
    return validate.starts_after_cutoff(ahead, cuts, P.WIDE)


HEADER = f"""{S.PAST}, head AS (SELECT u.series_id, c.cutoff_ts,
    count(*) FILTER (u.time <= c.cutoff_ts) AS n_past, count(*) FILTER (u.time > c.cutoff_ts) AS n_future
    FROM upload u JOIN cuts c ON c.series_id = u.series_id GROUP BY 1, 2)"""


@query(
    f"""WITH {HEADER} SELECT series_id, cutoff_ts, n_past, n_future, false AS has_actuals,
    concat_ws(',', CASE WHEN n_future >= 24 THEN '24' END, CASE WHEN n_future >= 72 THEN '72' END,
      CASE WHEN n_future >= 168 THEN '168' END) AS available_horizons FROM head"""
)
def available_horizons(spark: SparkSession, sf: str) -> DataFrame:
    """Header row of each accepted upload."""
    header = prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, order="row_order").header
    joined = F.array_join(F.transform("available_horizons", lambda h: h.cast("string")), ",")
    return header.withColumn("available_horizons", joined)


@query(
    f"""WITH {S.STATION_PANEL}, cuts AS (SELECT series_id, max(time) - INTERVAL 24 HOUR AS cutoff_ts FROM panel GROUP BY 1),
    ahead AS (SELECT p.* FROM panel p JOIN cuts c ON c.series_id = p.series_id WHERE p.time > c.cutoff_ts),
    whole AS (SELECT series_id FROM ahead GROUP BY 1 HAVING bool_and({S.ALL_KNOWN}))
    SELECT a.series_id, time, {S.rs(S.TARGETS)} FROM ahead a JOIN whole w ON w.series_id = a.series_id"""
)
def future_actuals(spark: SparkSession, sf: str) -> DataFrame:
    """Observed future targets, only of series where the whole future is known."""
    panel = P.station_panel(spark, sf)
    cuts = panel.groupBy("series_id").agg(F.max("time").alias("_last")).select(
        "series_id", clock.shift(F.col("_last"), -24 * 3600).alias("cutoff_ts")
    )
    prepared = prepare.prepare_upload(panel, P.WIDE, cutoffs=cuts)
    return P.settled(prepared.actuals, S.TARGETS)


CALENDAR = ", ".join(S.r(e, n) for n, e in S.calendar())


@query(f"WITH {S.PAST} SELECT series_id, time, {S.rs(S.MEASURED)}, {CALENDAR} FROM filled")
def preprocess_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Filled and aligned past rows of every accepted upload."""
    prepared = prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, order="row_order")
    return P.settled(prepared.past, P.WIDE.features)


@query(
    f"WITH {S.PAST} SELECT series_id, time, {', '.join(f'0.0::DOUBLE AS {c}' for c in S.TARGETS)}, "
    f"{S.rs(S.DRIVERS)}, {CALENDAR} FROM future"
)
def preprocess_future(spark: SparkSession, sf: str) -> DataFrame:
    prepared = prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, order="row_order")
    return P.settled(prepared.future, P.WIDE.features)


def _batch_sql() -> str:
    day = ", ".join(f"avg({c}) AS {c}" for c in S.TARGETS)
    lags = {"pm2_5_lag1": ("pm2_5", 1), "pm2_5_lag2": ("pm2_5", 2), "pm10_lag1": ("pm10", 1),
            "nitrogen_dioxide_lag1": ("nitrogen_dioxide", 1), "ozone_lag1": ("ozone", 1)}
    lagged = ", ".join(f"lag({c}, {n}) OVER (PARTITION BY series_id ORDER BY time) AS {k}" for k, (c, n) in lags.items())
    cols = S.TARGETS + list(lags)
    kept = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    bounds = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    scaled = ", ".join(
        S.r(f"({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END", c, 6) for c in cols
    )
    return f"""WITH {S.STATION_PANEL.replace('obs AS', 'hourly_obs AS').replace('FROM obs', 'FROM hourly_obs').replace('JOIN obs', 'JOIN hourly_obs')},
      dobs AS (SELECT series_id, date_trunc('day', time)::TIMESTAMP AS time, {day} FROM panel GROUP BY 1, 2),
      near AS (SELECT *, {S.SECONDS} AS sec, {S.neighbours(S.TARGETS, S.SECONDS)} FROM dobs),
      daily AS (SELECT series_id, time, {', '.join(f"{S.filled(c, S.line(c, 'sec'))} AS {c}" for c in S.TARGETS)} FROM near),
      lagged AS (SELECT series_id, time, {', '.join(S.TARGETS)}, {lagged} FROM daily),
      kept AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS back FROM lagged WHERE {kept}),
      st AS (SELECT series_id AS k, {bounds} FROM kept WHERE back > 7 GROUP BY 1)
      SELECT series_id, time, CASE WHEN back <= 7 THEN 'test' ELSE 'train' END AS split, {scaled}
      FROM kept JOIN st ON st.k = series_id"""


@query(_batch_sql())
def batch_preparation(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means, gaps filled, lags, last week held out, scaled to the training range."""
    raw = P.station_panel(spark, sf).withColumn("city", F.col("series_id"))
    scaled = prepare.batch_frames(raw, P.WIDE).scaled
    cols = [c for c in scaled.columns if c not in ("series_id", "time", "split")]
    return P.settled(scaled, cols, 6)
