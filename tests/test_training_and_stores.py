"""Training, stored models, backtests, run history and CSV."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from frames import hourly, typed_frame
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chronoloom.plans import history, prepare, recursive, training
from chronoloom.sources import artifacts, csv
from chronoloom.sources.history import HistoryStore
from chronoloom.spec import AIR_QUALITY, ArtifactMissingError, PanelValidationError

SMALL = AIR_QUALITY.but(targets=("pm10", "pm2_5"), window=4)


def wave(n=300, series="w", seed=0) -> pd.DataFrame:
    """A daily wave with noise: easy to beat by any model that looks at the clock."""
    rng = np.random.default_rng(seed)
    t = pd.date_range("2025-01-01", periods=n, freq="h")
    day = np.sin(2 * np.pi * t.hour / 24)
    return pd.DataFrame({
        "series_id": series, "time": t, "pm10": 20 + 8 * day + rng.normal(0, 0.3, n),
        "pm2_5": 10 - 4 * day + rng.normal(0, 0.3, n), "temperature": 10 + 3 * day, "wind_speed": rng.normal(3, 0.5, n),
    })


@pytest.fixture(scope="module")
def frames(spark):
    pdf = pd.concat([wave(series="a"), wave(series="b", seed=1), wave(n=60, series="too_short")])
    return training.training_frames(typed_frame(spark, pdf), SMALL)


def test_training_frames(frames):
    counts = frames.samples.groupBy("series_id", "split").count().toPandas()
    got = {(r.series_id, r.split): r["count"] for _, r in counts.iterrows()}
    assert got == {("a", "train"): 236, ("a", "test"): 56, ("b", "train"): 236, ("b", "test"): 56}


def test_linear_beats_repeating_and_trees_are_repeatable(spark, frames, tmp_path):
    linear = training.train_linear(frames, SMALL)
    scored = training.evaluate(training.predict_samples(frames, linear, SMALL), SMALL).toPandas().set_index("target")
    assert scored.loc["pm10", "mae"] < 1.0 and scored.loc["pm10", "r2"] > 0.9

    settings = training.TreeSettings(rounds=6, depth=3)
    trees = training.train_trees(frames, SMALL, settings)
    again = training.train_trees(frames, SMALL, settings)
    assert [t.toDebugString for t in trees][0].split("\n")[1:] == again[0].toDebugString.split("\n")[1:]

    place = str(tmp_path / "model")
    artifacts.save(place, "trees", trees, frames.stats, SMALL)
    loaded = artifacts.load(spark, place, SMALL)
    assert loaded.features == SMALL.features and loaded.window == 4
    width, known = len(SMALL.features), len(SMALL.features) - len(SMALL.targets)
    rng = np.random.default_rng(3)
    series = [(f"s{n}", rng.normal(size=(4, width)).tolist(), rng.normal(size=(n, known)).tolist()) for n in (1, 8, 3)]
    state = spark.createDataFrame(series, "series_id string, history array<array<double>>, drivers array<array<double>>")
    rolled = {r.series_id: r.preds for r in recursive.apply_models(state, SMALL, loaded.predictor, 8, 3).collect()}
    for name, history_rows, drivers in series:
        rows = list(history_rows)
        for step, ahead in enumerate(drivers):
            flat = Vectors.dense(np.concatenate(rows[-4:]))
            want = [m.predict(flat) for m in trees]
            np.testing.assert_allclose(rolled[name][step], want, rtol=1e-9)
            rows.append([*want, *ahead])
        assert len(rolled[name]) == len(drivers)
    assert artifacts.feature_order(spark, [str(tmp_path / "absent"), place], AIR_QUALITY) == SMALL.features
    assert artifacts.feature_order(spark, [str(tmp_path / "absent")], AIR_QUALITY) == AIR_QUALITY.features
    up = typed_frame(spark, hourly(seed=3))
    found = prepare.prepare_upload(up, AIR_QUALITY, model_paths=(str(tmp_path / "absent"), place))
    assert found.past.columns == ["series_id", "time", *SMALL.features]
    with pytest.raises(ArtifactMissingError):
        artifacts.load(spark, str(tmp_path / "absent"), SMALL)
    with pytest.raises(PanelValidationError):
        artifacts.save(place, "trees", trees[:1], frames.stats, SMALL)


def test_backtest_scores_only_observed_targets(spark):
    pdf = pd.concat([wave(n=1000, series="a"), wave(n=700, series="january_only")])
    pdf.loc[pdf.index[800:810], "pm10"] = np.nan
    panel = typed_frame(spark, pdf)

    class Last:
        def predict(self, windows):
            return windows[:, -1, :2]

    stats = spark.createDataFrame(
        [tuple([0.0] * len(SMALL.features) + [1.0] * len(SMALL.features))],
        ", ".join([f"{c}_mu double" for c in SMALL.features] + [f"{c}_sigma double" for c in SMALL.features]),
    )
    out = training.backtest_months(panel, SMALL, 2025, 1, 2, Last(), stats).toPandas()
    assert out["series_id"].unique().tolist() == ["a"] and len(out) == 1000 - 744
    assert out["pm10_actual"].isna().sum() == 10
    january = pdf[(pdf["series_id"] == "a") & (pdf["time"].dt.month == 1)]
    np.testing.assert_allclose(out["pm10_pred"], january["pm10"].iloc[-1])
    # The same months of another year are another period.
    assert training.backtest_months(panel, SMALL, 2024, 1, 2, Last(), stats).count() == 0
    leaky = training.backtest_months(panel, SMALL, 2025, 1, 2, Last(), stats, fill_before_split=True).toPandas()
    assert leaky["pm10_actual"].isna().sum() == 0


def run_rows(spark, rows):
    return spark.createDataFrame(
        rows, "run_id string, user_id bigint, timestamp string, model_used string, results string, inserted_seq bigint"
    )


@pytest.fixture()
def store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "history"))
    store.append_runs(run_rows(spark, [
        ("r1", 1, "2026-01-01T08:00:00+00:00", "LSTM", '{"a": 1}', 1),
        ("r2", 1, "2026-01-05T08:00:00+00:00", " XGBoost ", "not json", 2),
        ("r3", 1, "2026-02-01T08:00:00+00:00", "LSTM", "{}", 3),
        ("r4", 2, "2026-01-02T08:00:00+00:00", "LSTM", "{}", 4),
    ]))
    return store


def ids(df):
    return [r["run_id"] for r in df.collect()]


def test_history_reads(store):
    assert ids(history.recent_runs(store.runs(1), 2, user_id=1)) == ["r3", "r2"]
    texts = {r["run_id"]: r["results"] for r in history.recent_runs(store.runs(), 50).collect()}
    assert json.loads(texts["r2"]) == {"raw": "not json"} and texts["r1"] == '{"a": 1}'
    runs = store.runs(1)
    assert sorted(ids(history.filtered_runs(runs, start_date="2026-01-05", end_date="2026-02-01"))) == ["r2", "r3"]
    assert sorted(ids(history.filtered_runs(runs, model_used="XGBoost"))) == ["r2"]
    assert sorted(ids(history.filtered_runs(runs, model_used="All"))) == ["r1", "r2", "r3"]
    assert ids(history.newest_first(runs)) == ["r3", "r2", "r1"]
    assert {r["date"] for r in history.run_list(runs).collect()} >= {"2026-01-01T08:00"}


def test_history_deletes(store, tmp_path):
    store.delete_run(2, "r1")  # not the owner
    assert sorted(ids(store.runs(1))) == ["r1", "r2", "r3"]
    store.delete_run(1, "r1")
    assert sorted(ids(store.runs())) == ["r2", "r3", "r4"]
    store.delete_user(1)
    compacted = store.compact(str(tmp_path / "next"))
    assert ids(store.runs()) == ["r4"] == ids(compacted.runs())


def test_append_defaults_and_checks(spark, store):
    more = spark.createDataFrame([(9, "LSTM", "{}", b"a,b\n1,2\n")], "user_id bigint, model_used string, results string, dataset_csv binary")
    store.append_runs(more)
    row = store.runs(9).first()
    assert row["run_id"] and row["timestamp"].endswith("+00:00") and row["inserted_seq"] > 4
    assert history.stored_files(store.runs(9), "dataset_csv").first()["content"] == "a,b\n1,2\n"
    with pytest.raises(PanelValidationError, match="label"):
        store.append_runs(more.withColumn("model_used", F.lit("  ")))
    with pytest.raises(PanelValidationError, match="JSON"):
        store.append_runs(more.withColumn("results", F.lit("{broken")), any_text=False)
    store.append_runs(more, any_text=False)
    with pytest.raises(PanelValidationError, match="results"):
        store.append_runs(more.drop("results"))


def test_settings(spark, store):
    put = lambda u, m: store.put_settings(spark.createDataFrame([(u, m)], "user_id bigint, default_model string"))
    put(1, "XGBoost")
    put(2, "ARIMA")
    put(1, "Prophet")
    put(3, "XGBoost")
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4)], "user_id bigint")
    got = {r["user_id"]: r["default_model"] for r in history.settings_of(users, store.settings()).collect()}
    assert got == {1: "LSTM", 2: "LSTM", 3: "XGBoost", 4: "LSTM"}
    legacy = spark.createDataFrame([(1, "ARIMA", "dark", None)], "user_id bigint, default_model string, theme string, updated_at timestamp_ntz")
    assert history.migrated_settings(legacy).columns == ["user_id", "default_model", "updated_at"]
    assert history.migrated_settings(legacy).first()["default_model"] == "LSTM"


def test_payload_rows_from_store(spark):
    body = json.dumps({"history": [{"time": "t0", "pm10": 1.0}], "forecast": [{"time": "t1", "pm10": 2.0, "pm10_actual": 3.0}]})
    runs = spark.createDataFrame([("a", body, None), ("b", "broken", None), ("c", body, b"x")],
                                 "run_id string, results string, prediction_csv binary").withColumn("dataset_csv", F.lit(None).cast("binary"))
    rows = history.prediction_rows(runs, SMALL).collect()
    assert [(r["run_id"], r["time"], r["pm10"], r["pm10_actual"]) for r in rows] == [("a", "t1", 2.0, 3.0)]
    assert sorted(r["run_id"] for r in history.dataset_rows(runs, SMALL).collect()) == ["a", "c"]


def test_csv(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    for name, seed in (("north", 1), ("south", 2)):
        hourly(seed=seed).drop(columns="series_id").to_csv(folder / f"{name}.csv", index=False)
    raw = csv.read_uploads(spark, str(folder), AIR_QUALITY)
    out = prepare.prepare_upload(raw, AIR_QUALITY, order="row_order")
    assert {r["series_id"]: r["n_past"] for r in out.header.collect()} == {"north": 60, "south": 60}
    panel = csv.read_panel_csv(spark, str(folder / "north.csv"), AIR_QUALITY, "north")
    assert dict(panel.dtypes)["time"] == "timestamp_ntz" and dict(panel.dtypes)["pm10"] == "double"
    csv.write_csv(panel.limit(3), str(tmp_path / "out"))
    assert csv.read_text_csv(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(FileNotFoundError, match="no dataset"):
        csv.read_text_csv(spark, str(tmp_path / "absent.csv"))
