"""Recursive one-step forecasts (K5-K7) and the frames around them.

A forecast is sequential in time and parallel over series.  The last rows and
the future drivers of a series become one row of arrays (both of bounded
length), so series spread evenly whatever their history.  A short linear model
is folded over the future inside Catalyst.  Any other model is applied to many
series at once: each step is one call on a batch of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import clock
from chronoloom.operators import combine, scale, validate, windows
from chronoloom.plans.prepare import PreparedPanel
from chronoloom.session import durable
from chronoloom.spec import PanelSpec

PAYLOAD_SOURCE = "upload_full_models"


class Predictor(Protocol):
    """Scaled windows ``(n, window, features)`` to scaled targets ``(n, targets)``."""

    def predict(self, windows: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class PerWindow:
    """A predictor from a function of one ``(window, features)`` array."""

    fn: Callable[[np.ndarray], np.ndarray]

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return np.stack([np.asarray(self.fn(w), dtype=np.float64) for w in windows])


@dataclass(frozen=True)
class LinearModel:
    """Weights per target over the last ``rows`` rows, flattened oldest first, and intercepts."""

    rows: int
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def predict(self, windows: np.ndarray) -> np.ndarray:
        flat = windows[:, -self.rows:, :].reshape(len(windows), -1)
        return flat @ np.asarray(self.weights).T + np.asarray(self.intercepts)


def series_state(
    panel: PreparedPanel, spec: PanelSpec, horizon: int, stats: DataFrame, stat_keys: tuple[str, ...] = ()
) -> DataFrame:
    """State (see :func:`gather_state`) of the series with at least ``horizon`` future rows."""
    header = validate.check_horizon(panel.header, spec, horizon).select(spec.key, "cutoff_ts")
    last = clock.shift(F.col("cutoff_ts"), horizon * spec.cadence_seconds)
    ahead = panel.future.join(header, spec.key).filter(F.col(spec.time) <= last).drop("cutoff_ts")
    state = gather_state(panel.past, ahead, spec, stats, stat_keys)
    return state.filter(F.size("times") == horizon)


def refused(panel: PreparedPanel, spec: PanelSpec, horizon: int) -> DataFrame:
    """Series without a forecast and the rule that stopped them.

    Those refused by preparation, those with too few future rows (C8), and those whose future does not begin one tick
    after the cutoff (C10).
    """
    late = validate.starts_after_cutoff(panel.future, panel.header, spec)
    found = validate.gather([
        validate.horizon_failures(panel.header, spec, horizon), validate.late_failures(late, spec)
    ])
    return panel.failures.unionByName(validate.first_failures(found, spec))


def gather_state(
    past: DataFrame, ahead: DataFrame, spec: PanelSpec, stats: DataFrame, stat_keys: tuple[str, ...] = ()
) -> DataFrame:
    """One row per series with a full window of past rows and some future rows.

    ``history``: the last ``spec.window`` feature rows, scaled.  ``times`` and
    ``drivers``: the future steps and the features known for them, scaled.
    ``used``: the drivers in original units.  ``mu`` and ``sigma``: scaling of
    the targets.  ``ahead`` must be bounded per series by the caller's horizon.
    """
    known = (*spec.drivers, *spec.calendar)
    recent = windows.newest_rows(past, spec, spec.window)
    history = (
        scale.apply_zscore(recent, stats, spec.features, stat_keys)
        .groupBy(spec.key)
        .agg(F.array_sort(F.collect_list(F.struct(spec.time, F.array(*spec.features).alias("x")))).alias("_h"))
    )
    scaled = scale.apply_zscore(ahead.withColumn("_used", F.array(*spec.drivers)), stats, known, stat_keys)
    future = scaled.groupBy(spec.key).agg(
        F.array_sort(
            F.collect_list(F.struct(spec.time, F.array(*known).alias("d"), F.col("_used").alias("used")))
        ).alias("_f")
    )
    target_scale = {
        "mu": F.array(*[F.col(f"{t}_mu") for t in spec.targets]),
        "sigma": F.array(*[F.col(f"{t}_sigma") for t in spec.targets]),
    }
    return (
        scale.attach(history.join(future, spec.key), stats, stat_keys)
        .withColumns(target_scale)
        .filter(F.size("_h") == spec.window)
        .select(
            spec.key,
            F.transform("_h", lambda s: s["x"]).alias("history"),
            F.transform("_f", lambda s: s[spec.time]).alias("times"),
            F.transform("_f", lambda s: s["d"]).alias("drivers"),
            F.transform("_f", lambda s: s["used"]).alias("used"),
            "mu",
            "sigma",
        )
    )


def fold_linear(state: DataFrame, spec: PanelSpec, model: LinearModel) -> DataFrame:
    """Forecast with a short linear model, without leaving Catalyst.

    Adds ``preds``: scaled targets per step.
    """
    width = len(spec.features)
    if len(model.weights) != len(spec.targets) or len(model.intercepts) != len(spec.targets):
        raise ValueError("The model needs one weight vector and intercept per target.")
    if any(len(w) != model.rows * width for w in model.weights):
        raise ValueError("The model needs one weight per row and feature.")
    def weighted(flat: Column, weights: tuple[float, ...], start: float) -> Column:
        terms = [flat[i] * F.lit(w) for i, w in enumerate(weights) if w != 0.0]
        total = F.lit(start)
        for term in terms:
            total = total + term
        return total

    def step(acc: Column, drivers: Column) -> Column:
        flat = F.flatten(acc["rows"])
        pred = F.array(*[weighted(flat, w, b) for w, b in zip(model.weights, model.intercepts)])
        row = F.concat(pred, drivers)
        return F.struct(
            F.concat(F.slice(acc["rows"], 2, model.rows - 1), F.array(row)).alias("rows"),
            F.concat(acc["preds"], F.array(pred)).alias("preds"),
        )

    recent = F.slice("history", spec.window - model.rows + 1, model.rows)
    empty = F.array().cast("array<array<double>>")
    start = F.struct(recent.alias("rows"), empty.alias("preds"))
    folded = F.aggregate("drivers", start, step, lambda acc: acc["preds"])
    return state.withColumn("preds", folded)


def apply_predictor(state: DataFrame, spec: PanelSpec, predictor: Predictor) -> DataFrame:
    """Forecast with any predictor, many series per call; adds ``preds`` as :func:`fold_linear` does."""
    n_targets = len(spec.targets)
    schema = T.StructType([*state.schema.fields, T.StructField("preds", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            history = _cube(batch["history"])
            lengths = batch["drivers"].map(len).to_numpy()
            drivers = np.array([r for d in batch["drivers"] for r in d], dtype=np.float64)
            flat_start = np.cumsum(lengths) - lengths
            preds = np.empty((len(batch), lengths.max(), n_targets))
            for i in range(lengths.max()):
                out = np.asarray(predictor.predict(history), dtype=np.float64)
                if out.shape != (len(batch), n_targets):
                    raise ValueError(f"The predictor returned {out.shape}, not {(len(batch), n_targets)}.")
                preds[:, i, :] = out
                # A series past its last step keeps its last drivers; those rows are cut off below.
                known = drivers[flat_start + np.minimum(i, lengths - 1)]
                row = np.concatenate([out, known], axis=1)
                history = np.concatenate([history[:, 1:, :], row[:, None, :]], axis=1)
            yield batch.assign(preds=[[list(r) for r in p[:n]] for p, n in zip(preds, lengths)])

    # A series is few bytes but many steps of work, so series are dealt over all tasks first.
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return state.repartition(parts, spec.key).mapInPandas(run, schema)


def apply_models(
    state: DataFrame, spec: PanelSpec, models: list[Model], horizon: int, stored_every: int = 6
) -> DataFrame:
    """Forecast with one fitted MLlib model per target; adds ``preds`` as :func:`fold_linear` does.

    A step is one ``transform`` of all series per model.  The state is stored every few steps, so plans stay short
    and a lost executor costs few steps.  It is a few bytes per series but much work, so it is dealt by series first.
    """
    if len(models) != len(spec.targets):
        raise ValueError(f"{len(models)} models for {len(spec.targets)} targets.")
    width = len(spec.features)
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.array().cast("array<array<double>>")
    frame = state.repartition(parts, spec.key).withColumns({"_x": F.flatten("history"), "preds": empty})
    for i in range(horizon):
        frame = frame.withColumn("_v", array_to_vector("_x"))
        for j, model in enumerate(models):
            frame = model.copy().setFeaturesCol("_v").setPredictionCol(f"_p{j}").transform(frame)
        frame = frame.withColumn("_row", F.array(*[F.col(f"_p{j}") for j in range(len(models))]))
        # A series past its last step keeps its last drivers; its predictions are complete by then.
        known = F.coalesce(F.get("drivers", F.lit(i)), F.element_at("drivers", -1))
        frame = frame.select(
            *state.columns,
            F.concat(F.slice("_x", width + 1, (spec.window - 1) * width), "_row", known).alias("_x"),
            F.when(F.size("drivers") > i, F.concat("preds", F.array("_row"))).otherwise(F.col("preds")).alias("preds"),
        )
        if i % stored_every == stored_every - 1 and i + 1 < horizon:
            frame = durable(frame)
    return frame.drop("_x")


def _cube(column: pd.Series) -> np.ndarray:
    return np.stack([np.stack([np.asarray(r, dtype=np.float64) for r in rows]) for rows in column])


def seasonal_naive(state: DataFrame, spec: PanelSpec, season: int = 24) -> DataFrame:
    """Repeat the last ``season`` rows; adds ``preds``."""
    n = len(spec.targets)
    recent = F.slice("history", spec.window - season + 1, season)
    pick = F.transform(
        F.sequence(F.lit(0), F.size("drivers") - 1),
        lambda i: F.slice(F.get(recent, i % season), 1, n),
    )
    return state.withColumn("preds", pick)


def forecast_rows(
    predicted: DataFrame,
    spec: PanelSpec,
    model_name: str,
    horizon: int,
    actuals: DataFrame | None = None,
) -> DataFrame:
    """One row per series and step, in output order.

    Key, time, ``<target>_pred``, ``<driver>_used``, model, horizon and, when
    given, ``<target>_actual`` matched on the hour.
    """
    steps = predicted.select(
        spec.key, "mu", "sigma", F.explode(F.arrays_zip("times", "preds", "used")).alias("_s")
    )
    preds = [
        (F.col("_s.preds")[j] * F.col("sigma")[j] + F.col("mu")[j]).alias(f"{t}_pred")
        for j, t in enumerate(spec.targets)
    ]
    used = [F.col("_s.used")[j].alias(f"{d}_used") for j, d in enumerate(spec.drivers)]
    out = steps.select(
        spec.key,
        F.col("_s.times").alias(spec.time),
        *preds,
        *used,
        F.lit(model_name).alias("model_name"),
        F.lit(horizon).alias("forecast_horizon"),
    )
    return out if actuals is None else combine.with_actuals(out, actuals, spec)


def require_finite(forecast: DataFrame, spec: PanelSpec) -> DataFrame:
    """The same rows; the job fails when a predicted or used number is not finite (C11)."""
    cols = [f"{t}_pred" for t in spec.targets] + [f"{d}_used" for d in spec.drivers]
    bad = F.lit(False)
    for c in cols:
        bad = bad | validate.unusable(c)
    checked = F.when(bad, F.raise_error(F.lit("The forecast has a value that is not finite."))).otherwise(
        F.col(cols[0])
    )
    return forecast.withColumn(cols[0], checked)


def forecast(
    panel: PreparedPanel,
    spec: PanelSpec,
    horizon: int,
    model: Predictor | list[Model],
    stats: DataFrame,
    model_name: str,
    stat_keys: tuple[str, ...] = (),
    fold: bool = False,
) -> DataFrame:
    """Forecast every accepted series with a fitted model and attach known actuals.

    ``model`` is a predictor, or a list of MLlib models, one per target.  ``fold`` asks for a linear model to be
    folded inside Catalyst, which suits short ones.  :func:`refused` lists the series without a forecast.
    """
    state = series_state(panel, spec, horizon, stats, stat_keys)
    if isinstance(model, list):
        predicted = apply_models(state, spec, model, horizon)
    elif fold:
        predicted = fold_linear(state, spec, model)
    else:
        predicted = apply_predictor(state, spec, model)
    rows = forecast_rows(predicted, spec, model_name, horizon, panel.actuals)
    return require_finite(rows, spec)


def payload(panel: PreparedPanel, forecast_df: DataFrame, spec: PanelSpec, model_name: str, horizon: int) -> DataFrame:
    """One JSON text per series: the last past rows and the forecast rows (K9)."""
    cols = spec.measured
    recent = windows.newest_rows(panel.past.select(spec.key, spec.time, *cols), spec, spec.window)
    history = recent.groupBy(spec.key).agg(
        F.array_sort(
            F.collect_list(F.struct(clock.iso_utc(F.col(spec.time)).alias("time"), *cols))
        ).alias("history")
    )
    fields = [clock.iso_utc(F.col(spec.time)).alias("time")]
    fields += [F.col(f"{t}_pred").alias(t) for t in spec.targets]
    fields += [F.col(f"{d}_used") for d in spec.drivers]
    extra = ["pm25_safety_level", *[f"{t}_actual" for t in spec.targets]]
    fields += [F.col(c) for c in extra if c in forecast_df.columns]
    ahead = forecast_df.groupBy(spec.key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("forecast")
    )
    body = F.struct(
        F.lit(model_name).alias("model"),
        F.lit(horizon).alias("forecast_horizon"),
        F.lit(PAYLOAD_SOURCE).alias("source"),
        clock.iso_utc(F.col("cutoff_ts")).alias("cutoff_ts"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        "history",
        "forecast",
    )
    joined = panel.header.select(spec.key, "cutoff_ts").join(history, spec.key).join(ahead, spec.key)
    return joined.select(spec.key, F.to_json(body).alias("results"))


def payload_rows(stored: DataFrame, spec: PanelSpec, part: str, keys: tuple[str, ...], text: str = "results") -> DataFrame:
    """Rows of the ``history`` or ``forecast`` part of stored payloads (A5); other text gives no rows."""
    names = [*spec.measured] if part == "history" else (
        [*spec.targets, *[f"{d}_used" for d in spec.drivers], *[f"{t}_actual" for t in spec.targets]]
    )
    fields = ["time string", *[f"{c} double" for c in names]]
    if part == "forecast":
        fields.append("pm25_safety_level string")
    shape = f"struct<{part}: array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>>>"
    rows = stored.select(*keys, F.explode(F.from_json(text, shape)[part]).alias("_r"))
    return rows.select(*keys, "_r.*")


def mean_prediction(forecast_df: DataFrame, keys: tuple[str, ...], column: str = "pm2_5_pred") -> DataFrame:
    """Mean predicted value of a run."""
    return forecast_df.groupBy(*keys).agg(F.avg(column).alias(f"mean_{column}"))
