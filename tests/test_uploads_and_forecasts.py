"""Upload validation, preparation and recursive forecasts."""

from __future__ import annotations

import json
import sys

import numpy as np
import pandas as pd
import pytest
from frames import hourly, text_frame, typed_frame
from pyspark import cloudpickle
from pyspark.sql import functions as F

from chronoloom.functions import calendar, labels
from chronoloom.operators import scale, validate
from chronoloom.plans import prepare, recursive
from chronoloom.spec import (
    AIR_QUALITY as SPEC,
    POLLUTANTS,
    HorizonUnavailableError,
    PanelValidationError,
)

FEATURES = list(SPEC.features)

# Workers cannot import a test module; send its functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cutoff_frame(spark, rows):
    shaped = [(s, pd.Timestamp(t).to_pydatetime()) for s, t in rows]
    return spark.createDataFrame(shaped, "series_id string, cutoff_ts timestamp_ntz")


@pytest.fixture(scope="module")
def many(spark):
    """One upload per defect, all prepared together; good ones must be unharmed."""
    base = {n: hourly(seed=i, series=n) for i, n in enumerate(
        ["good", "gap", "dup", "bad_time", "last_only", "none_seen", "blank_future", "one_blank", "unfilled", "few"])}
    base["gap"] = base["gap"].drop(index=20)
    base["dup"] = pd.concat([base["dup"], base["dup"].iloc[[5, 6, 7, 8]]])
    base["last_only"].loc[:82, "pm10"] = np.nan
    base["last_only"].loc[83, list(POLLUTANTS)] = 1.0
    base["none_seen"]["ozone"] = np.nan
    base["blank_future"].loc[60:, "temperature"] = np.nan
    base["one_blank"].loc[70, "wind_speed"] = np.nan
    base["few"] = hourly(n_past=10, seed=3, series="few")
    base["good"].loc[10, "pm2_5"] = np.nan
    extra = {"kept": hourly(n_future=80, seed=20, series="kept")}
    texts = [pd.concat([*base.values(), *extra.values()])]
    raw = text_frame(spark, texts[0]).withColumn(
        "time", F.when(F.col("series_id") == "bad_time", F.lit("not-a-date")).otherwise(F.col("time"))
    )
    return prepare.prepare_upload(raw.withColumnRenamed("pm10", " PM10 ").withColumn("lat", F.lit("1")), SPEC)


def test_each_defect_is_named(many):
    got = {r["series_id"]: (r["rule"], r["detail"]) for r in many.failures.collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "gap": "broken_cadence", "dup": "duplicate_time", "bad_time": "unreadable_time",
        "last_only": "no_future_after_cutoff", "none_seen": "no_observed_row",
        "blank_future": "bad_future_drivers",
        "one_blank": "bad_future_drivers", "few": "short_past",
    }
    assert "2024-01-01T19:00:00+00:00 -> 2024-01-01T21:00:00+00:00 is a step of 2.0 h" in got["gap"][1]
    assert got["dup"][1].count("+00:00") == 3
    assert "2024-01-03T22:00:00+00:00" in got["one_blank"][1]
    assert "(+19 more)" in got["blank_future"][1]
    with pytest.raises(PanelValidationError, match="bad_time: unreadable_time"):
        validate.enforce(_as_ranked(many.failures), SPEC)


def _as_ranked(failures):
    return failures.withColumn("rank", F.lit(0))


def test_good_uploads_go_on(many):
    header = {r["series_id"]: r for r in many.header.collect()}
    assert set(header) == {"good", "unfilled", "kept"}
    assert (header["good"]["n_past"], header["good"]["n_future"]) == (60, 24)
    assert list(header["kept"]["available_horizons"]) == [24, 72]
    assert not header["good"]["has_actuals"]
    past = many.past.filter("series_id = 'good'").toPandas().sort_values("time")
    assert list(past.columns) == ["series_id", "time", *FEATURES]
    assert not past.isna().any().any()
    assert past["pm2_5"].iloc[10] == pytest.approx((past["pm2_5"].iloc[9] + past["pm2_5"].iloc[11]) / 2)
    future = many.future.filter("series_id = 'good'").toPandas()
    assert (future[list(POLLUTANTS)] == 0.0).all().all()


def test_unfilled_past_column(spark):
    pdf = hourly(series="s")
    pdf["so2_seen"] = 1.0
    pdf.loc[:59, "ozone"] = np.nan
    cut = cutoff_frame(spark, [("s", "2024-01-03 11:00:00")])
    out = prepare.prepare_upload(typed_frame(spark, pdf.drop(columns="so2_seen")), SPEC, cutoffs=cut)
    row = out.failures.first()
    assert row["rule"] == "unfilled_past" and row["detail"].endswith("ozone")


def test_explicit_cutoffs(spark):
    pdf = pd.concat([hourly(series=s, seed=i, keep_targets=True) for i, s in enumerate(["a", "b", "c"])])
    cut = cutoff_frame(spark, [("a", "2024-01-03 11:00:00"), ("b", "2024-01-03 11:30:00")])
    out = prepare.prepare_upload(typed_frame(spark, pdf), SPEC, cutoffs=cut)
    header = {r["series_id"]: r for r in out.header.collect()}
    assert (header["a"]["n_past"], header["a"]["n_future"]) == (60, 24)
    assert (header["c"]["n_past"], header["c"]["n_future"]) == (83, 1)
    assert {r["series_id"]: r["rule"] for r in out.failures.collect()} == {"b": "cutoff_not_in_data"}
    actuals = out.actuals.toPandas()
    assert len(actuals[actuals["series_id"] == "a"]) == 24
    cut_last = cutoff_frame(spark, [(s, "2024-01-04 11:00:00") for s in "abc"])
    ended = prepare.prepare_upload(typed_frame(spark, pdf), SPEC, cutoffs=cut_last)
    assert {r["rule"] for r in ended.failures.collect()} == {"no_future_rows"}


def test_missing_columns_are_named(spark):
    with pytest.raises(PanelValidationError, match="'time'"):
        prepare.read_panel(text_frame(spark, hourly()).withColumnRenamed("time", "t"), SPEC)
    with pytest.raises(PanelValidationError, match="pm10, ozone"):
        prepare.read_panel(text_frame(spark, hourly().drop(columns=["pm10", "ozone"])), SPEC)


def recorder():
    """A predictor leaning on every feature of the window, so any changed input shows."""
    return recursive.PerWindow(lambda w: np.array([w.sum() * 1e-3 * (k + 1) for k in range(6)]))


def run(spark, pdf, predictor, horizon=24, cut="2024-01-03 11:00:00"):
    panel = prepare.prepare_upload(
        typed_frame(spark, pdf), SPEC, cutoffs=cutoff_frame(spark, [(s, cut) for s in pdf["series_id"].unique()])
    )
    stats = scale.fit_zscore(panel.past, FEATURES)
    return panel, recursive.forecast(panel, SPEC, horizon, predictor, stats, "Test")


def test_future_weather_reaches_only_later_steps(spark):
    base = hourly(seed=4)
    moved = base.copy()
    moved.loc[60:, "temperature"] += 50
    a = run(spark, base, recorder())[1].toPandas().sort_values("time")
    b = run(spark, moved, recorder())[1].toPandas().sort_values("time")
    assert a["pm10_pred"].iloc[0] == pytest.approx(b["pm10_pred"].iloc[0])
    assert abs(a["pm10_pred"].iloc[1] - b["pm10_pred"].iloc[1]) > 1e-6


def test_future_targets_never_leak(spark):
    base = hourly(seed=5, keep_targets=True)
    spoiled = base.copy()
    spoiled.loc[60:, list(POLLUTANTS)] = 1e6
    cols = ["time", *[f"{t}_pred" for t in POLLUTANTS]]
    a = run(spark, base, recorder())[1].select(cols).toPandas().sort_values("time")
    out = run(spark, spoiled, recorder())[1]
    b = out.select(cols).toPandas().sort_values("time")
    np.testing.assert_allclose(a[cols[1:]], b[cols[1:]])
    assert out.select(F.max("pm10_actual")).first()[0] == 1e6


def test_matches_a_plain_loop_and_the_fold(spark):
    rng = np.random.default_rng(1)
    model = recursive.LinearModel(
        2, tuple(tuple(rng.normal(0, 0.05, 2 * len(FEATURES))) for _ in POLLUTANTS), tuple(rng.normal(0, 0.1, 6))
    )
    pdf = pd.concat([hourly(seed=i, series=f"s{i}", n_past=60 + 5 * i) for i in range(3)])
    panel = prepare.prepare_upload(text_frame(spark, pdf), SPEC)
    stats = scale.fit_zscore(panel.past, FEATURES)
    state = recursive.series_state(panel, SPEC, 24, stats)
    folded = recursive.forecast_rows(recursive.fold_linear(state, SPEC, model), SPEC, "m", 24).toPandas()
    batched = recursive.forecast_rows(recursive.apply_predictor(state, SPEC, model), SPEC, "m", 24).toPandas()
    key = ["series_id", "time"]
    cols = [f"{t}_pred" for t in POLLUTANTS]
    folded, batched = folded.sort_values(key), batched.sort_values(key)
    np.testing.assert_allclose(folded[cols], batched[cols], rtol=1e-9)
    assert len(folded) == 72

    one = panel.past.filter("series_id = 's1'").toPandas().sort_values("time")[FEATURES].to_numpy(float)
    all_rows = panel.past.toPandas()[FEATURES].to_numpy(float)
    mu, sigma = all_rows.mean(0), np.where(all_rows.std(0) < 1e-8, 1, all_rows.std(0))
    window = (one[-48:] - mu) / sigma
    ahead = panel.future.filter("series_id = 's1'").toPandas().sort_values("time")[FEATURES].to_numpy(float)
    want = []
    for i in range(24):
        p = np.asarray(model.weights) @ window[-2:].reshape(-1) + np.asarray(model.intercepts)
        row = (ahead[i] - mu) / sigma
        row[:6] = p
        window = np.vstack([window[1:], row])
        want.append(p * sigma[:6] + mu[:6])
    np.testing.assert_allclose(folded[folded["series_id"] == "s1"][cols], want, rtol=1e-9)


def test_output_columns_and_payload(spark):
    panel, out = run(spark, hourly(seed=6, keep_targets=True), recursive.PerWindow(lambda w: np.zeros(6)))
    want = ["series_id", "time", *[f"{t}_pred" for t in POLLUTANTS], "temperature_used", "wind_speed_used",
            "model_name", "forecast_horizon", *[f"{t}_actual" for t in POLLUTANTS]]
    assert out.columns == want
    banded = labels.with_safety_band(out)
    text = recursive.payload(panel, banded, SPEC, "Test", 24).first()["results"]
    body = json.loads(text)
    assert list(body) == ["model", "forecast_horizon", "source", "cutoff_ts", "columns", "history", "forecast"]
    assert len(body["history"]) == 48 and len(body["forecast"]) == 24
    assert body["cutoff_ts"] == "2024-01-03T11:00:00+00:00"
    assert body["forecast"][0]["time"] == "2024-01-03T12:00:00+00:00"
    assert {"pm25_safety_level", "pm10", "pm10_actual", "wind_speed_used"} <= set(body["forecast"][0])


def test_predictor_errors(spark):
    pdf = hourly(seed=7)
    with pytest.raises(Exception, match="predictor returned"):
        run(spark, pdf, recursive.PerWindow(lambda w: np.zeros(5)))[1].collect()
    with pytest.raises(Exception, match="not finite"):
        run(spark, pdf, recursive.PerWindow(lambda w: np.full(6, np.nan)))[1].collect()
    with pytest.raises(ValueError, match="per target"):
        recursive.fold_linear(None, SPEC, recursive.LinearModel(1, ((0.0,) * 16,), (0.0,)))


@pytest.mark.parametrize("horizon", [24, 72, 168])
def test_horizons(spark, horizon):
    header = spark.createDataFrame([("a", horizon - 1), ("b", horizon)], "series_id string, n_future bigint")
    assert [r["series_id"] for r in validate.check_horizon(header, SPEC, horizon).collect()] == ["b"]
    with pytest.raises(HorizonUnavailableError, match="a: horizon"):
        validate.require_horizon(header, SPEC, horizon)
    with pytest.raises(HorizonUnavailableError, match="not offered"):
        validate.check_horizon(header, SPEC, 48)


def test_calendar_matches_pandas(spark):
    pdf = pd.DataFrame({"series_id": "s", "time": pd.date_range("2023-12-25", periods=500, freq="5h")})
    got = calendar.with_calendar(typed_frame(spark, pdf), SPEC).toPandas()
    t = got["time"].dt
    np.testing.assert_allclose(got["h2_cos"], np.cos(4 * np.pi * t.hour / 24), atol=1e-12)
    np.testing.assert_allclose(got["dow_sin"], np.sin(2 * np.pi * t.dayofweek / 7), atol=1e-12)
    np.testing.assert_allclose(got["mon_cos"], np.cos(2 * np.pi * t.month / 12), atol=1e-12)


def test_batch_frames(spark):
    pdf = hourly(n_past=30 * 24, n_future=0, seed=42).assign(city="london").drop(columns="series_id")
    pdf.loc[3, "time"] = pd.NaT
    frames = prepare.batch_frames(typed_frame(spark, pdf), SPEC, test_days=5)
    prepared = frames.prepared.toPandas()
    assert len(prepared) == 30 and prepared["series_id"].unique().tolist() == ["london"]
    scaled = frames.scaled.toPandas()
    assert scaled["split"].value_counts().to_dict() == {"train": 23, "test": 5}
    train = scaled[scaled["split"] == "train"]
    assert train["pm2_5_lag1"].min() == 0.0 and train["pm2_5_lag1"].max() == 1.0


def test_start_and_finite_rules(spark):
    header = spark.sql("SELECT 'a' AS series_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS cutoff_ts")
    late = spark.sql("SELECT 'a' AS series_id, TIMESTAMP_NTZ '2024-01-01 02:00:00' AS time")
    due = spark.sql("SELECT 'a' AS series_id, TIMESTAMP_NTZ '2024-01-01 01:00:00' AS time")
    assert validate.starts_after_cutoff(late, header, SPEC).count() == 1
    assert validate.starts_after_cutoff(due, header, SPEC).count() == 0
    rows = [("a", 1.0), ("a", None), ("a", float("inf")), ("b", 2.0)]
    bad = validate.non_finite(spark.createDataFrame(rows, "k string, x double"), ["x"], "k").collect()
    assert [(r["k"], r["bad_rows"]) for r in bad] == [("a", 2)]
