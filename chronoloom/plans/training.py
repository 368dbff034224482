"""Training and evaluation of one-step models (K1-K4) and period backtests (K8).

One model is trained per target on the windows of all series, with MLlib, on
scaled features.  The scaler is fitted on training rows only.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import calendar
from chronoloom.operators import combine, fill, metrics, scale, schema, validate, windows
from chronoloom.plans import recursive
from chronoloom.session import durable, shared_folder
from chronoloom.spec import MIN_EXTRA_ROWS, PanelSpec, PanelValidationError

# Training fraction and model settings the results depend on.
TRAIN_FRACTION = 0.8


@dataclass(frozen=True)
class TreeSettings:
    rounds: int = 200
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: str = "0.8"
    seed: int = 42
    max_bins: int = 32


@dataclass(frozen=True)
class LinearSettings:
    epsilon: float = 1.35
    penalty: float = 0.0
    iterations: int = 100


@dataclass(frozen=True)
class TrainingFrames:
    """``samples``: key, split, time, ``features`` vector, ``y`` array, all scaled; ``stats``: the scaler."""

    samples: DataFrame
    stats: DataFrame


def too_small(panel: DataFrame, spec: PanelSpec, horizon: int = 1) -> DataFrame:
    """Series that :func:`usable_rows` leaves out, and how many complete rows they have."""
    kept = schema.complete_rows(schema.numeric_frame(panel, spec))
    return windows.too_short(kept, spec, spec.window + horizon + MIN_EXTRA_ROWS - 1, among=panel)


def usable_rows(panel: DataFrame, spec: PanelSpec, horizon: int = 1) -> DataFrame:
    """Complete rows of the series long enough to train on (B10, C13); :func:`too_small` lists the others."""
    kept = schema.complete_rows(schema.numeric_frame(panel, spec))
    minimum = spec.window + horizon + MIN_EXTRA_ROWS
    long = validate.enough_rows(kept, spec, minimum).filter("enough")
    return combine.only_series(kept, long, spec.key)


def training_frames(
    panel: DataFrame, spec: PanelSpec, horizon: int = 1, fraction: float | None = TRAIN_FRACTION
) -> TrainingFrames:
    """Calendar features, chronological split, scaling and windows.

    ``fraction=None`` uses every row for training.  No window crosses the split.
    """
    rows = calendar.with_calendar(usable_rows(panel, spec, horizon), spec)
    if fraction is None:
        labelled = rows.withColumn("split", F.lit("train"))
    else:
        labelled = windows.split_fraction(rows, spec, fraction)
    labelled = durable(labelled)
    stats = durable(scale.fit_zscore(labelled.filter("split = 'train'"), spec.features))
    scaled = scale.apply_zscore(labelled, stats, spec.features)
    built = windows.sliding_windows(
        scaled, spec, spec.features, spec.targets, horizon=horizon, parts=("split",)
    )
    flat = windows.flatten_windows(built).withColumn("features", array_to_vector("features"))
    return TrainingFrames(durable(flat.drop("window")), stats)


def with_validation(frames: TrainingFrames, spec: PanelSpec, share: float = 0.1) -> TrainingFrames:
    """The same samples, the last ``share`` of every series' training windows labelled ``valid``.

    Their targets come after all training targets of the series; the rows they look back on may be training rows.
    """
    known = frames.samples.filter("split = 'train'")
    parted = windows.split_fraction(known.drop("split"), spec, 1 - share)
    parted = parted.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise(F.col("split")))
    rest = frames.samples.filter("split <> 'train'")
    # Training passes over the samples many times, so they are dealt evenly over all tasks.
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return TrainingFrames(durable(parted.unionByName(rest).repartition(parts, spec.key, spec.time)), frames.stats)


def _per_target(samples: DataFrame, index: int) -> DataFrame:
    kept = samples.filter("split IN ('train', 'valid')")
    return kept.select("features", F.col("y")[index].alias("label"), (F.col("split") == "valid").alias("valid"))


def train_trees(frames: TrainingFrames, spec: PanelSpec, settings: TreeSettings = TreeSettings()) -> list[Model]:
    """Boosted trees with squared loss, one regressor per target, fitted side by side (K1, K2).

    With validation samples a target stops at the first round that does not lower its validation error.
    """
    spark = frames.samples.sparkSession
    shared_folder(spark)  # boosting rounds checkpoint there
    learner = GBTRegressor(
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.step,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=settings.column_share,
        maxBins=settings.max_bins,
        seed=settings.seed,
        validationTol=0.0,
    )
    if not frames.samples.filter("split = 'valid'").isEmpty():
        learner = learner.setValidationIndicatorCol("valid")
    fit = inheritable_thread_target(spark)(lambda i: learner.fit(_per_target(frames.samples, i)))
    with ThreadPool(len(spec.targets)) as pool:
        return pool.map(fit, range(len(spec.targets)))


def train_linear(frames: TrainingFrames, spec: PanelSpec, settings: LinearSettings = LinearSettings()) -> list[Model]:
    """Outlier-robust linear regression, one per target (K3)."""
    learner = LinearRegression(
        loss="huber",
        epsilon=settings.epsilon,
        regParam=settings.penalty,
        maxIter=settings.iterations,
        standardization=False,
    )
    return [learner.fit(_per_target(frames.samples, i)) for i in range(len(spec.targets))]


def linear_model(models: list[Model], spec: PanelSpec) -> recursive.LinearModel:
    """The fitted weights as a forecast model."""
    return recursive.LinearModel(
        rows=spec.window,
        weights=tuple(tuple(float(w) for w in m.coefficients.toArray()) for m in models),
        intercepts=tuple(float(m.intercept) for m in models),
    )


def predict_samples(
    frames: TrainingFrames, models: list[Model], spec: PanelSpec, split: str = "test"
) -> DataFrame:
    """One-step predictions in original units: ``<target>_pred`` and ``<target>_actual`` (K4)."""
    if len(models) != len(spec.targets):
        raise PanelValidationError(f"{len(models)} models for {len(spec.targets)} targets.")
    out = frames.samples.filter(F.col("split") == split)
    renames = {}
    for i, (target, model) in enumerate(zip(spec.targets, models)):
        model = model.copy().setPredictionCol(f"{target}_pred")
        out = model.transform(out).withColumn(f"{target}_actual", F.col("y")[i])
        renames.update({f"{target}_pred": target, f"{target}_actual": target})
    raw = out.select(spec.key, spec.time, *renames)
    return scale.invert_zscore(raw, frames.stats, renames)


def evaluate(predicted: DataFrame, spec: PanelSpec, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy per target, over all series or per key, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(f"{t}_actual").alias("y"), F.col(f"{t}_pred").alias("p"))
            for t in spec.targets
        ]
    )
    long = predicted.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")
    return metrics.accuracy(long, "y", "p", (*keys, "target"))


def _with_values(df: DataFrame, spec: PanelSpec, cols: tuple[str, ...]) -> DataFrame:
    """Series with at least one value in every column."""
    seen = F.array(*[F.count(c) for c in cols])
    return df.groupBy(spec.key).agg(F.array_min(seen).alias("_n")).filter("_n > 0")


def backtest(
    history: DataFrame,
    target: DataFrame,
    spec: PanelSpec,
    model: recursive.Predictor,
    stats: DataFrame,
    stat_keys: tuple[str, ...] = (),
    filled: bool = False,
) -> DataFrame:
    """Forecast a past period with its known drivers, next to what was observed (K8).

    Each side is filled on its own, and a target that was not observed stays
    NULL in ``<target>_actual``, so filled values are never scored.  ``filled``
    says both sides were filled together beforehand.
    """
    keys = (spec.key, spec.time)
    past = history.select(*keys, *spec.measured)
    ahead = target.select(*keys, *spec.drivers)
    if not filled:
        past = fill.fill_linear(past, spec, spec.measured)
        ahead = fill.fill_linear(ahead, spec, spec.drivers)
    # A filled column has gaps only where a series has no value of it at all.
    past = combine.only_series(past, _with_values(history, spec, spec.measured), spec.key)
    ahead = combine.only_series(ahead, _with_values(target, spec, spec.drivers), spec.key)
    past = calendar.with_calendar(past, spec)
    ahead = calendar.with_calendar(ahead, spec)
    state = recursive.gather_state(past, ahead, spec, stats, stat_keys)
    rows = recursive.forecast_rows(recursive.apply_predictor(state, spec, model), spec, "", 0)
    preds = rows.drop("model_name", "forecast_horizon")
    observed = schema.suffixed(target.select(*keys, *spec.targets), spec.targets, "_actual")
    return combine.side_by_side([preds, observed], spec)


def backtest_months(
    panel: DataFrame,
    spec: PanelSpec,
    year: int,
    history_month: int,
    target_month: int,
    model: recursive.Predictor,
    stats: DataFrame,
    stat_keys: tuple[str, ...] = (),
    fill_before_split: bool = False,
) -> DataFrame:
    """Backtest one calendar month on an earlier one of ``year``, of the series that have both.

    :func:`validate.months_present` tells which series those are.
    """
    usable = validate.months_present(panel, spec, year, history_month, target_month).filter("usable")
    kept = combine.only_series(panel, usable, spec.key)
    if fill_before_split:
        kept = fill.fill_linear(kept, spec, spec.measured)
    history = schema.calendar_month(kept, spec, year, history_month)
    target_year = schema.year_of_target(year, history_month, target_month)
    target = schema.calendar_month(kept, spec, target_year, target_month)
    return backtest(history, target, spec, model, stats, stat_keys, filled=fill_before_split)
