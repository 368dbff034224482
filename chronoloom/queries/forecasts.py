"""Recursive forecasts, their output and their accuracy over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import calendar, clock, labels
from chronoloom.operators import combine, metrics, scale, schema, windows
from chronoloom.plans import boosting, lagged, prepare, recursive, training
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query
from chronoloom.session import durable, scratch_path
from chronoloom.sources import artifacts

PREDS = [f"{t}_pred" for t in S.TARGETS]
USED = [f"{d}_used" for d in S.DRIVERS]


def _prepared(spark: SparkSession, sf: str) -> prepare.PreparedPanel:
    return prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, order="row_order")


def _fitted(panel: prepare.PreparedPanel) -> DataFrame:
    """Scaling fitted on the past rows of each series."""
    return durable(scale.fit_zscore(panel.past, P.WIDE.features, ("series_id",)))


def _naive(panel: prepare.PreparedPanel, horizon: int) -> DataFrame:
    state = recursive.series_state(panel, P.WIDE, horizon, _fitted(panel), ("series_id",))
    return recursive.seasonal_naive(state, P.WIDE)


def _naive_rows(spark: SparkSession, sf: str, horizon: int) -> tuple[prepare.PreparedPanel, DataFrame]:
    panel = _prepared(spark, sf)
    rows = recursive.forecast_rows(_naive(panel, horizon), P.WIDE, "Naive", horizon)
    return panel, labels.with_safety_band(rows)


@query(
    f"""WITH {S.naive(72)} SELECT series_id, time, {', '.join(S.r(t, f'{t}_pred') for t in S.TARGETS)},
    {S.rs(USED)}, 'Naive' AS model_name, 72 AS forecast_horizon FROM predicted"""
)
def recursive_naive(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _naive_rows(spark, sf, 72)
    return P.settled(rows.drop("pm25_safety_level"), PREDS + USED)


ROUNDED_PREDS = ", ".join(S.r(t, f"{t}_pred") for t in S.TARGETS)
BAND = """CASE WHEN {c} IS NULL THEN 'High' WHEN {c} <= 12.0 THEN 'Low' WHEN {c} <= 35.4 THEN 'Moderate' ELSE 'High' END"""
ACTUALS = ", ".join(S.r(f"b.{t}", f"{t}_actual") for t in S.TARGETS)
NAIVE_OUT = f"""WITH {S.naive(24)} SELECT q.series_id, q.time, {', '.join(S.r(f'q.{t}', f'{t}_pred') for t in S.TARGETS)},
    {', '.join(S.r(f'q.{u}', u) for u in USED)}, 'Naive' AS model_name, 24 AS forecast_horizon, {ACTUALS},
    {BAND.replace('{c}', 'q.pm2_5')} AS pm25_safety_level
    FROM predicted q LEFT JOIN panel b ON b.series_id = q.series_id AND b.time = q.time"""


def _with_station_actuals(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return combine.with_actuals(rows, P.station_panel(spark, sf), P.WIDE)


@query(NAIVE_OUT)
def forecast_output(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast rows with the observed targets of the same hours and the safety band."""
    _, rows = _naive_rows(spark, sf, 24)
    out = _with_station_actuals(spark, sf, rows)
    return P.settled(out, PREDS + USED + [f"{t}_actual" for t in S.TARGETS])


@query(
    f"WITH {S.naive(24)} SELECT series_id, strftime(time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS time, {S.rs(S.TARGETS)}, "
    f"{S.rs(USED)}, {BAND.replace('{c}', 'pm2_5')} AS pm25_safety_level FROM predicted"
)
def payload_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast rows read back from the stored JSON payload."""
    panel, rows = _naive_rows(spark, sf, 24)
    stored = recursive.payload(panel, rows, P.WIDE, "Naive", 24)
    back = recursive.payload_rows(stored, P.WIDE, "forecast", ("series_id",))
    return P.settled(back.select("series_id", "time", *S.TARGETS, *USED, "pm25_safety_level"), S.TARGETS + USED)


@query(
    f"WITH {S.naive(24)} SELECT series_id, strftime(time, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS time, {S.rs(S.MEASURED)} "
    "FROM placed WHERE back <= 48 AND series_id IN (SELECT series_id FROM enough)"
)
def payload_history(spark: SparkSession, sf: str) -> DataFrame:
    """Last past rows read back from the stored JSON payload."""
    panel, rows = _naive_rows(spark, sf, 24)
    stored = recursive.payload(panel, rows, P.WIDE, "Naive", 24)
    return P.settled(recursive.payload_rows(stored, P.WIDE, "history", ("series_id",)), S.MEASURED)


@query(f"WITH {S.naive(72)} SELECT series_id, {S.r('avg(pm2_5)', 'mean_pm2_5_pred')} FROM predicted GROUP BY 1")
def mean_prediction(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _naive_rows(spark, sf, 72)
    return P.settled(recursive.mean_prediction(rows, ("series_id",)), ["mean_pm2_5_pred"])


# A two-lag linear model: each target leans on its own last two values, on the
# last temperature and on the last hour-of-day sine.
LAG1, LAG2, BY_TEMPERATURE, BY_HOUR, BASE = 0.5, 0.3, 0.1, -0.2, 0.05


def two_lag_model() -> recursive.LinearModel:
    features = list(P.WIDE.features)
    width = len(features)
    weights = []
    for target in S.TARGETS:
        w = [0.0] * (2 * width)
        w[features.index(target)] = LAG2
        w[width + features.index(target)] = LAG1
        w[width + features.index("temperature")] = BY_TEMPERATURE
        w[width + features.index("h_sin")] = BY_HOUR
        weights.append(tuple(w))
    return recursive.LinearModel(2, tuple(weights), (BASE,) * len(S.TARGETS))


def _linear_sql(horizon: int) -> str:
    z = {c: f"({{v}} - m_{c}) / CASE WHEN s_{c} < 1e-8 THEN 1.0 ELSE s_{c} END" for c in [*S.MEASURED, "h_sin"]}
    fit = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in [*S.MEASURED, "h_sin"])
    hsin = "sin(2 * pi() * hour(time) / 24)"
    scaled = ", ".join(f"{z[c].format(v='p.' + c)} AS {c}" for c in [*S.MEASURED, "h_sin"])
    start = ", ".join(
        f"max(CASE WHEN back = 1 THEN {t} END) AS {t}_1, max(CASE WHEN back = 2 THEN {t} END) AS {t}_2" for t in S.TARGETS
    )
    nxt = ", ".join(
        f"{LAG1} * {t}_1 + {LAG2} * {t}_2 + {BY_TEMPERATURE} * r.temp + {BY_HOUR} * r.hs + {BASE} AS {t}_1, {t}_1 AS {t}_2"
        for t in S.TARGETS
    )
    back = ", ".join(
        S.r(f"{t}_1 * CASE WHEN s_{t} < 1e-8 THEN 1.0 ELSE s_{t} END + m_{t}", f"{t}_pred") for t in S.TARGETS
    )
    return f"""WITH RECURSIVE {S.PAST},
      wide AS (SELECT *, {hsin} AS h_sin, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS back FROM filled),
      st AS (SELECT series_id AS k, {fit} FROM wide GROUP BY 1),
      zs AS (SELECT p.series_id, back, {scaled} FROM wide p JOIN st ON st.k = p.series_id),
      fut AS (SELECT p.series_id, p.time, p.step, p.temperature AS temperature_used, p.wind_speed AS wind_speed_used,
                {z['temperature'].format(v='p.temperature')} AS temp, {z['h_sin'].format(v=hsin)} AS hs
              FROM future p JOIN st ON st.k = p.series_id WHERE p.step <= {horizon}),
      run AS (SELECT series_id, 0 AS step, max(CASE WHEN back = 1 THEN temperature END) AS temp,
                max(CASE WHEN back = 1 THEN h_sin END) AS hs, {start} FROM zs WHERE back <= 2 GROUP BY 1
        UNION ALL
        SELECT r.series_id, r.step + 1 AS step, f.temp, f.hs, {nxt}
        FROM run r JOIN fut f ON f.series_id = r.series_id AND f.step = r.step + 1)
      SELECT r.series_id, f.time, {back}, {S.rs(USED, prefix='f.')}, 'Linear' AS model_name, {horizon} AS forecast_horizon
      FROM run r JOIN fut f ON f.series_id = r.series_id AND f.step = r.step JOIN st ON st.k = r.series_id WHERE r.step > 0"""


@query(_linear_sql(72))
def recursive_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Two-lag linear model folded inside Catalyst."""
    panel = _prepared(spark, sf)
    state = recursive.series_state(panel, P.WIDE, 72, _fitted(panel), ("series_id",))
    rows = recursive.forecast_rows(
        recursive.fold_linear(state, P.WIDE, two_lag_model()), P.WIDE, "Linear", 72
    )
    return P.settled(recursive.require_finite(rows, P.WIDE), PREDS + USED)


@query(_linear_sql(72))
def recursive_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """The same model as a plug-in predictor over batches of series."""
    panel = _prepared(spark, sf)
    state = recursive.series_state(panel, P.WIDE, 72, _fitted(panel), ("series_id",))
    rows = recursive.forecast_rows(
        recursive.apply_predictor(state, P.WIDE, two_lag_model()), P.WIDE, "Linear", 72
    )
    return P.settled(recursive.require_finite(rows, P.WIDE), PREDS + USED)


# Accuracy of "same as 24 rows before", on the complete rows of the wide panel.
LAGGED_SQL = f"""WITH {S.STATION_PANEL}, kept AS (SELECT * FROM panel WHERE {S.ALL_KNOWN}),
    pairs AS (SELECT series_id, time, pm2_5 AS y, lag(pm2_5, 24) OVER (PARTITION BY series_id ORDER BY time) AS p,
              lag(pm2_5, 1) OVER (PARTITION BY series_id ORDER BY time) AS p1 FROM kept)"""
MEASURES = ["mae", "rmse", "smape", "r2", "pearson_r", "sigma_true", "sigma_pred"]


def _measure_sql(p: str) -> str:
    return f"""count(*) AS n, {S.r(f'avg(abs(y - {p}))', 'mae')}, {S.r(f'sqrt(avg((y - {p}) ** 2))', 'rmse')},
      {S.r(f'100 * avg(abs(y - {p}) / greatest((abs(y) + abs({p})) / 2, 1e-8))', 'smape')},
      {S.r(f'1 - sum((y - {p}) ** 2) / (var_pop(y) * count(y))', 'r2')}, {S.r(f'corr(y, {p})', 'pearson_r')},
      {S.r('stddev_pop(y)', 'sigma_true')}, {S.r(f'stddev_pop({p})', 'sigma_pred')}"""


def _lagged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    kept = P.station_panel(spark, sf).na.drop("any").select("series_id", "time", F.col("pm2_5").alias("y"))
    return windows.with_lags(kept, P.WIDE, {"p": ("y", 24), "p1": ("y", 1)})


@query(f"{LAGGED_SQL} SELECT series_id, {_measure_sql('p')} FROM pairs WHERE p IS NOT NULL GROUP BY 1")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(metrics.accuracy(_lagged_pairs(spark, sf), "y", "p", ("series_id",)), MEASURES)


@query(
    f"""{LAGGED_SQL}, scores AS (SELECT series_id, 'day_before' AS candidate, avg(abs(y - p)) AS loss FROM pairs WHERE p IS NOT NULL GROUP BY 1
    UNION ALL SELECT series_id, 'hour_before', avg(abs(y - p1)) FROM pairs WHERE p1 IS NOT NULL GROUP BY 1)
    SELECT series_id, min_by(candidate, loss) AS best, {S.r('min(loss)', 'best_loss')} FROM scores GROUP BY 1"""
)
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _lagged_pairs(spark, sf)
    scores = [
        metrics.accuracy(pairs, "y", p, ("series_id",)).select("series_id", F.lit(name).alias("candidate"), "mae")
        for name, p in (("day_before", "p"), ("hour_before", "p1"))
    ]
    best = metrics.best_candidate(scores[0].unionByName(scores[1]), "candidate", "mae", ("series_id",))
    return P.settled(best, ["best_loss"])


def _backtest_sql() -> str:
    z = ", ".join(S.r(f"q.{t}", f"{t}_pred") for t in S.TARGETS)
    picks = ", ".join(f"p.{c} AS {c}" for c in S.TARGETS)
    fills = ", ".join(f"{S.filled(c, S.line(c, 'pos'))} AS {c}" for c in S.MEASURED)
    return f"""WITH {S.STATION_PANEL},
      cuts AS (SELECT series_id, max(time) - INTERVAL 120 HOUR AS cutoff_ts FROM panel GROUP BY 1),
      past AS (SELECT p.*, row_number() OVER (PARTITION BY p.series_id ORDER BY time) - 1 AS pos
               FROM panel p JOIN cuts c ON c.series_id = p.series_id WHERE time <= cutoff_ts),
      near AS (SELECT *, {S.neighbours(S.MEASURED, 'pos')} FROM past),
      filled AS (SELECT series_id, time, {fills} FROM near),
      placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS back FROM filled),
      ahead AS (SELECT p.*, CAST((epoch(time) - epoch(cutoff_ts)) / 3600 AS INTEGER) AS step
                FROM panel p JOIN cuts c ON c.series_id = p.series_id WHERE time > cutoff_ts),
      q AS (SELECT f.series_id, f.time, {picks} FROM ahead f JOIN placed p
            ON p.series_id = f.series_id AND p.back = 48 - ((f.step - 1) % 48))
      SELECT q.series_id, q.time, {z}, {S.rs(S.DRIVERS, prefix='f.').replace('AS temperature', 'AS temperature_used').replace('AS wind_speed', 'AS wind_speed_used')},
        {', '.join(S.r(f'f.{t}', f'{t}_actual') for t in S.TARGETS)}
      FROM q JOIN ahead f ON f.series_id = q.series_id AND f.time = q.time"""


class OldestRow:
    """Repeats the window: the next row equals the oldest row still in it."""

    def predict(self, history):
        return history[:, 0, : len(S.TARGETS)]


@query(_backtest_sql())
def backtest_period(spark: SparkSession, sf: str) -> DataFrame:
    """The last five days of each series forecast from the days before, next to what was observed."""
    panel = durable(P.station_panel(spark, sf))
    cuts = panel.groupBy("series_id").agg(F.max("time").alias("_last")).select(
        "series_id", clock.shift(F.col("_last"), -120 * 3600).alias("cutoff_ts")
    )
    past, ahead = prepare.cut(panel, cuts, P.WIDE)
    stats = durable(scale.fit_zscore(calendar.with_calendar(past, P.WIDE), P.WIDE.features, ("series_id",)))
    out = training.backtest(past, ahead, P.WIDE, OldestRow(), stats, ("series_id",))
    return P.settled(out, PREDS + USED + [f"{t}_actual" for t in S.TARGETS])


SCORES = " UNION ALL ".join(
    f"""SELECT '{t}' AS target, count(*) AS n, {S.r(f'avg(abs({t}_actual - {t}_pred))', 'mae', 3)},
    {S.r(f'sqrt(avg(({t}_actual - {t}_pred) ** 2))', 'rmse', 3)} FROM b WHERE {t}_actual IS NOT NULL"""
    for t in S.TARGETS
)


@query(f"WITH b AS ({_backtest_sql()}) {SCORES}")
def backtest_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the backtest per target, over the hours where it was observed."""
    scored = training.evaluate(backtest_period(spark, sf), P.WIDE)
    return P.settled(scored.select("target", "n", "mae", "rmse"), ["mae", "rmse"], 3)


# Learned models at full windows, targets and settings; checked for rows only, as SQL cannot train.


def _all_rows(spark: SparkSession, sf: str) -> training.TrainingFrames:
    return training.training_frames(P.station_panel(spark, sf), P.WIDE, fraction=None)


def _validated(spark: SparkSession, sf: str, fraction: float | None = training.TRAIN_FRACTION) -> training.TrainingFrames:
    frames = training.training_frames(P.station_panel(spark, sf), P.WIDE, fraction=fraction)
    return training.with_validation(frames, P.WIDE)


@query()
def train_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees with squared loss per target, up to 200 rounds: hold-out accuracy."""
    frames = _validated(spark, sf)
    models = training.train_trees(frames, P.WIDE)
    return training.evaluate(training.predict_samples(frames, models, P.WIDE), P.WIDE)


@query()
def train_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees with pseudo-Huber loss per target, up to 200 rounds: hold-out accuracy of each target's best round."""
    frames = _validated(spark, sf)
    model = boosting.train_boosted(frames, P.WIDE)
    return training.evaluate(boosting.predict_boosted(frames, model, P.WIDE), P.WIDE)


@query()
def boosting_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of every round of boosting on all rows, and the round chosen by validation loss."""
    model = boosting.train_boosted(_validated(spark, sf, None), P.WIDE)
    chosen = boosting.chosen_rounds(model.losses).withColumnsRenamed({"best": "best_round"})
    return model.losses.join(chosen, "target")


@query()
def train_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Huber regression per target, full window and settings: hold-out accuracy."""
    frames = training.training_frames(P.station_panel(spark, sf), P.WIDE)
    models = training.train_linear(frames, P.WIDE)
    return training.evaluate(training.predict_samples(frames, models, P.WIDE), P.WIDE)


@query()
def forecast_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on all rows, stored, loaded and rolled forward 24 hours."""
    frames = _validated(spark, sf, None)
    models = training.train_trees(frames, P.WIDE)
    place = scratch_path(spark, "model")
    artifacts.save(place, "trees", models, frames.stats, P.WIDE)
    model = artifacts.load(spark, place, P.WIDE)
    panel = prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, features=model.features, order="row_order")
    return recursive.forecast(panel, P.WIDE, 24, model.predictor, model.stats, "Trees")


@query()
def forecast_linear(spark: SparkSession, sf: str) -> DataFrame:
    """Huber regression on all rows, rolled forward 24 hours."""
    frames = _all_rows(spark, sf)
    models = training.train_linear(frames, P.WIDE)
    panel = prepare.prepare_upload(P.upload_text(spark, sf), P.WIDE, order="row_order")
    return recursive.forecast(panel, P.WIDE, 24, training.linear_model(models, P.WIDE), frames.stats, "Linear")


@query()
def train_lagged(spark: SparkSession, sf: str) -> DataFrame:
    """Huber regression per target without stored windows: hold-out accuracy."""
    data = lagged.lagged_rows(P.station_panel(spark, sf), P.WIDE)
    model = lagged.train_huber(data, P.WIDE)
    return training.evaluate(lagged.predict_lagged(data, model, P.WIDE), P.WIDE)


LAGGED = P.WIDE.but(window=3, calendar=())
TERMS = ", ".join(
    ["1.0"] + [f"lag({c}, {n}) OVER w" for n in (3, 2, 1) for c in LAGGED.features] + list(LAGGED.targets)
)


@query(
    f"""WITH {S.STATION_PANEL}, rows AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) AS p FROM panel WHERE {S.ALL_KNOWN}),
    terms AS (SELECT series_id, p, [{TERMS}] AS t FROM rows WINDOW w AS (PARTITION BY series_id ORDER BY time)),
    long AS (SELECT t, unnest(range(31)) AS i FROM terms WHERE p > 3)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {S.r('sum(t[i + 1] * t[j + 1])', 'product', 2)}
    FROM long, (SELECT unnest(range(31)) AS j) GROUP BY ALL"""
)
def lagged_products(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of products of all lagged columns and targets over windows of three rows: what a linear model is solved from."""
    whole = schema.complete_rows(P.station_panel(spark, sf).select("series_id", "time", *LAGGED.features))
    rows = lagged.blocked(whole.withColumn("split", F.lit("train")), LAGGED, ("split",))
    products = lagged.cross_products(lagged.LaggedRows(rows, whole), LAGGED)
    cells = [(i, j, float(v)) for i, line in enumerate(products) for j, v in enumerate(line)]
    return P.settled(spark.createDataFrame(cells, "i int, j int, product double"), ["product"], 2)
