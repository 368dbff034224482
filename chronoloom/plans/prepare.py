"""Preparation flows: forecast input from uploads (D17) and batch panels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import calendar, clock, coerce
from chronoloom.operators import combine, fill, scale, schema, validate, windows
from chronoloom.session import durable
from chronoloom.spec import PanelSpec


@dataclass(frozen=True)
class PreparedPanel:
    """Forecast input of every accepted series.

    ``past`` and ``future`` hold the features in model order; targets in
    ``future`` are 0.0 and must not be read.  ``actuals`` has the observed
    future targets of the series where all of them are known.  ``header`` has
    one row per series, ``failures`` one per rejected series.
    """

    past: DataFrame
    future: DataFrame
    actuals: DataFrame
    header: DataFrame
    failures: DataFrame


def read_panel(raw: DataFrame, spec: PanelSpec, order: str | None = None) -> DataFrame:
    """Names, dropped metadata, strict time parsing, required columns, numbers (in that order)."""
    named = schema.drop_metadata(schema.normalise_names(raw))
    coerce.require_time_column(named, spec)
    schema.require_columns(named, spec.required_past, "past")
    parsed = coerce.parse_time_strict(named, spec, order)
    numbers = coerce.numeric(parsed, spec.measured)
    return numbers.select(spec.key, spec.time, *spec.measured)


def prepare_upload(
    raw: DataFrame,
    spec: PanelSpec,
    cutoffs: DataFrame | None = None,
    features: tuple[str, ...] | None = None,
    order: str | None = None,
    stage: Callable[[DataFrame], DataFrame] = durable,
    model_paths: tuple[str, ...] = (),
) -> PreparedPanel:
    """Validate, cut, fill and align many uploads at once.

    The columns of the result are ``features``, or else those of the first readable model among ``model_paths``, or
    else the panel's own (A11).

    ``cutoffs`` may name the cutoff of some series (``timestamp_ntz``, UTC); the
    others have theirs detected.  Rejected series end in ``failures`` and leave the other frames.  ``stage``
    writes the parsed panel, the failures and the headers once, as the rules and
    the results each read them.
    """
    parsed = stage(read_panel(raw, spec, order))
    unread = validate.unreadable_times(parsed, spec)
    panel = coerce.drop_unreadable_times(parsed, spec)
    counts = validate.time_counts(panel, spec)
    structural = [
        unread,
        validate.duplicate_failures(counts, spec),
        validate.cadence_failures(counts, spec),
    ]
    sums = stage(validate.block_summary(panel, spec))
    cuts, cut_failures = _cutoffs(panel, cutoffs, spec, sums)
    cuts = stage(cuts)
    summary = stage(validate.cut_summary(panel, cuts, spec, sums))
    bad_hours = validate.bad_future_times(panel, cuts, spec)
    failures = stage(validate.first_failures(
        validate.gather(
            [
                *structural,
                cut_failures,
                validate.past_failures(summary, spec),
                validate.future_failures(summary, bad_hours, spec),
            ]
        ),
        spec,
    ))
    header = stage(combine.without_series(summary, failures, spec.key).select(
        spec.key,
        "cutoff_ts",
        "n_past",
        "n_future",
        "has_actuals",
        validate.available_horizons(F.col("n_future"), spec).alias("available_horizons"),
    ))
    if features is None:
        from chronoloom.sources import artifacts  # reads models, which rest on this module

        features = artifacts.feature_order(raw.sparkSession, list(model_paths), spec)
    return _aligned(panel, header, failures, spec, features)


def _cutoffs(
    panel: DataFrame, wanted: DataFrame | None, spec: PanelSpec, sums: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The cutoff of each series, as asked for or else detected, and the failures on the way."""
    found = validate.detect_cutoff(panel, spec, sums)
    if wanted is None:
        cuts = found.filter(F.col("cutoff_ts").isNotNull()).select(spec.key, "cutoff_ts")
        return cuts, validate.cutoff_failures(found, spec)
    checked = validate.explicit_cutoff(panel, wanted, spec)
    automatic = combine.without_series(found, wanted, spec.key)
    cuts = checked.filter("in_data").select(spec.key, "cutoff_ts").unionByName(
        automatic.filter(F.col("cutoff_ts").isNotNull()).select(spec.key, "cutoff_ts")
    )
    failures = validate.explicit_cutoff_failures(checked, spec).unionByName(
        validate.cutoff_failures(automatic, spec)
    )
    return cuts, failures


def _aligned(
    panel: DataFrame, header: DataFrame, failures: DataFrame, spec: PanelSpec, features: tuple[str, ...]
) -> PreparedPanel:
    keys = (spec.key, spec.time)
    past_raw, future_raw = cut(panel, header.select(spec.key, "cutoff_ts"), spec)
    filled = fill.fill_limited(past_raw, spec, spec.measured)
    past = schema.align(calendar.with_calendar(filled, spec), features, keys)
    drivers = future_raw.select(*keys, *spec.drivers)
    future = schema.align(calendar.with_calendar(drivers, spec), features, keys)
    whole = header.filter("has_actuals")
    actuals = combine.only_series(future_raw.select(*keys, *spec.targets), whole, spec.key)
    return PreparedPanel(past, future, actuals, header, failures)


def cut(panel: DataFrame, cutoffs: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff and rows from one tick after it."""
    joined = panel.join(cutoffs, spec.key)
    start = clock.shift(F.col("cutoff_ts"), spec.cadence_seconds)
    past = joined.filter(F.col(spec.time) <= F.col("cutoff_ts")).select(*panel.columns)
    future = joined.filter(F.col(spec.time) >= start).select(*panel.columns)
    return past, future


def prepare_batch(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Fixed schema, lenient times, daily means, gaps filled in time (D3)."""
    shaped = schema.expected_schema(raw, spec)
    timed = coerce.drop_unreadable_times(coerce.parse_time_lenient(shaped, spec), spec)
    daily = fill.resample_daily(coerce.numeric(timed, spec.targets), spec, spec.targets)
    return fill.fill_time(daily, spec.daily(), spec.targets)


@dataclass(frozen=True)
class BatchFrames:
    """Stages of the offline batch flow; ``scaled`` and ``lagged`` carry the ``split`` label.

    ``rejected`` has the series with too few rows to hold out the last days.
    """

    prepared: DataFrame
    lagged: DataFrame
    scaler: DataFrame
    scaled: DataFrame
    rejected: DataFrame


def batch_frames(
    raw: DataFrame,
    spec: PanelSpec,
    target: str = "pm2_5",
    test_days: int = 7,
    stage: Callable[[DataFrame], DataFrame] = durable,
) -> BatchFrames:
    """Clean, lag, hold out the last days, scale to the training range."""
    prepared = stage(prepare_batch(raw, spec))
    daily = spec.daily()
    lagged = windows.lag_features(prepared, daily, target, regular=True)
    rejected = windows.too_short(lagged, daily, test_days, among=prepared)
    lagged = windows.holdout_last(lagged, daily, test_days)
    cols = [c for c in lagged.columns if c not in (spec.key, spec.time, "split")]
    scaler = scale.fit_minmax(lagged.filter("split = 'train'"), cols, (spec.key,))
    return BatchFrames(prepared, lagged, scaler, scale.apply_minmax(lagged, scaler, cols, (spec.key,)), rejected)
