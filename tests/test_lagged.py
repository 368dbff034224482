"""Huber regression without stored windows: the matrix against SQL, the weights against MLlib, predictions against windows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from frames import typed_frame
from test_training_and_stores import SMALL, wave

from chronoloom.plans import lagged, training

SPEC = SMALL.but(block_rows=64)


@pytest.fixture(scope="module")
def panel(spark):
    pdf = pd.concat([wave(n=300, series="a"), wave(n=260, series="b", seed=1), wave(n=60, series="too_short")])
    pdf.loc[pdf.index % 37 == 5, "pm10"] += 40  # outliers
    return typed_frame(spark, pdf)


@pytest.fixture(scope="module")
def data(panel):
    return lagged.lagged_rows(panel, SPEC)


def test_matrix_by_sql(data, tmp_path):
    got = lagged.cross_products(data, SPEC)
    data.rows.filter("_own AND split = 'train'").write.parquet(f"{tmp_path}/rows")
    names = [f"l{lag}_{i}" for lag in range(SPEC.window, 0, -1) for i in range(len(SPEC.features))]
    lags = ", ".join(f"lag(x[{int(n.split('_')[1]) + 1}], {n[1:].split('_')[0]}) OVER w AS {n}" for n in names)
    rows = duckdb.sql(
        f"SELECT 1.0 AS one, {lags}, y[1] AS y1, y[2] AS y2 FROM '{tmp_path}/rows/*.parquet' WINDOW w AS (PARTITION BY series_id ORDER BY _pos)"
    )
    every = ["one", *names, "y1", "y2"]
    some = every[:5] + every[30:34] + every[-6:]
    sums = ", ".join(f"sum({a} * {b})" for a in some for b in some)
    want = np.array(duckdb.sql(f"SELECT {sums} FROM rows WHERE {names[0]} IS NOT NULL").fetchall()[0], float).reshape(len(some), -1)
    at = [every.index(c) for c in some]
    np.testing.assert_allclose(got[np.ix_(at, at)], want, rtol=1e-9, atol=1e-9)
    assert got.shape == (len(every),) * 2


def test_weights_and_predictions_equal_those_on_windows(panel, data):
    model = lagged.train_huber(data, SPEC)
    frames = training.training_frames(panel, SPEC)
    on_windows = training.train_linear(frames, SPEC, training.LinearSettings(iterations=500))
    want = training.predict_samples(frames, on_windows, SPEC).toPandas().sort_values(["series_id", "time"])
    got = lagged.predict_lagged(data, model, SPEC).toPandas().sort_values(["series_id", "time"])
    assert len(got) == len(want) > 50
    for c in ("pm10", "pm2_5"):
        np.testing.assert_allclose(got[f"{c}_actual"], want[f"{c}_actual"], rtol=1e-9)
        np.testing.assert_allclose(got[f"{c}_pred"], want[f"{c}_pred"], atol=0.02)


def test_rows_are_stored_about_once(panel, data):
    own = data.rows.filter("_own").count()
    assert own == data.rows.select("series_id", "time").distinct().count()
    assert data.rows.count() < 1.2 * own
