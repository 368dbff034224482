"""Ordered operators against pandas, with blocks far shorter than the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from frames import typed_frame
from pyspark.sql import functions as F

from chronoloom.operators import blocks, fill, windows
from chronoloom.spec import PanelSpec

SPEC = PanelSpec(targets=("y",), drivers=(), block_rows=5)


def gappy(seed: int, n: int = 120, series: int = 3) -> pd.DataFrame:
    """Hourly series with NULL runs of many lengths, also at both ends."""
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(series):
        y = rng.normal(0, 10, n)
        at = 0
        while at < n:
            run = int(rng.integers(1, 25))
            y[at:at + run] = np.nan
            at += run + int(rng.integers(1, 6))
        if s == 2:
            y[:] = np.nan
        frames.append(
            pd.DataFrame({"series_id": f"s{s}", "time": pd.date_range("1969-12-30", periods=n, freq="h"), "y": y})
        )
    return pd.concat(frames, ignore_index=True)


def by_pandas(pdf: pd.DataFrame, fn) -> np.ndarray:
    parts = [fn(g.set_index("time")["y"]).to_numpy() for _, g in pdf.groupby("series_id", sort=True)]
    return np.concatenate(parts)


def values(df) -> np.ndarray:
    return df.toPandas().sort_values(["series_id", "time"])["y"].astype(float).to_numpy()


@pytest.mark.parametrize("seed", [1, 2])
def test_limited_fill_matches_pandas(spark, seed):
    pdf = gappy(seed)
    want = by_pandas(pdf, lambda s: s.interpolate(method="time", limit=6, limit_direction="both").ffill().bfill())
    got = values(fill.fill_limited(typed_frame(spark, pdf), SPEC, ["y"]))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_time_fill_matches_pandas(spark):
    pdf = gappy(3).drop(index=[7, 8, 50, 170])
    want = by_pandas(pdf, lambda s: s.interpolate(method="time").ffill().bfill())
    np.testing.assert_allclose(values(fill.fill_time(typed_frame(spark, pdf), SPEC, ["y"])), want, atol=1e-9)


def test_linear_fill_is_positional(spark):
    pdf = gappy(4).drop(index=[3, 4, 5, 60, 61, 200])
    want = by_pandas(pdf, lambda s: s.interpolate(limit_direction="both").ffill().bfill())
    np.testing.assert_allclose(values(fill.fill_linear(typed_frame(spark, pdf), SPEC, ["y"])), want, atol=1e-9)


def test_carry_fill(spark):
    pdf = gappy(5)
    want = by_pandas(pdf, lambda s: s.ffill().bfill())
    np.testing.assert_allclose(values(fill.fill_carry(typed_frame(spark, pdf), SPEC, ["y"])), want)


def test_daily_resample_keeps_empty_days(spark):
    pdf = gappy(6, n=200, series=2)
    pdf = pdf[~pdf["time"].dt.date.astype(str).isin(["1970-01-02", "1970-01-03"])]
    want = np.concatenate(
        [g.set_index("time")["y"].resample("D").mean().to_numpy() for _, g in pdf.groupby("series_id")]
    )
    got = values(fill.resample_daily(typed_frame(spark, pdf), SPEC, ["y"]))
    np.testing.assert_allclose(got, want)


def test_positions_and_time_at_position(spark):
    pdf = gappy(7).drop(index=[3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 60, 200])
    df = typed_frame(spark, pdf)
    placed = blocks.with_positions(df, SPEC).toPandas().sort_values(["series_id", "time"])
    assert (placed["_pos"] == placed.groupby("series_id").cumcount()).all()
    assert (placed["_len"] == placed.groupby("series_id")["time"].transform("size")).all()
    at = blocks.time_at_position(df, SPEC, F.floor(F.col("_len") * 0.8), "t").toPandas()
    for _, row in at.iterrows():
        times = pdf[pdf["series_id"] == row["series_id"]]["time"].sort_values().to_numpy()
        assert pd.Timestamp(times[int(len(times) * 0.8)]) == row["t"]


@pytest.mark.parametrize("regular", [False, True])
def test_lags_cross_block_edges(spark, regular):
    pdf = gappy(8)
    lags = {"a": ("y", 1), "b": ("y", 7)}
    got = windows.with_lags(typed_frame(spark, pdf), SPEC, lags, regular).toPandas().sort_values(["series_id", "time"])
    by = pdf.groupby("series_id")["y"]
    np.testing.assert_allclose(got["a"].astype(float), by.shift(1))
    np.testing.assert_allclose(got["b"].astype(float), by.shift(7))


def test_time_steps_over_empty_blocks(spark):
    pdf = gappy(9).drop(index=list(range(20, 60)))
    got = windows.time_steps(typed_frame(spark, pdf), SPEC).toPandas().sort_values(["series_id", "time"])
    want = pdf.groupby("series_id")["time"].diff().dt.total_seconds() / 3600
    np.testing.assert_allclose(got["step_hours"].astype(float), want)


@pytest.mark.parametrize("horizon", [1, 3])
@pytest.mark.parametrize("strict", [False, True])
def test_windows(spark, horizon, strict):
    pdf = gappy(10, series=2).drop(index=[40, 41])
    pdf["y"] = np.arange(len(pdf), dtype=float)
    got = windows.sliding_windows(
        typed_frame(spark, pdf), SPEC, ["y"], ["y"], window=8, horizon=horizon, strict_time=strict
    ).toPandas()
    want = {}
    for s, g in pdf.groupby("series_id"):
        y, t = g["y"].to_numpy(), g["time"].to_numpy()
        for i in range(len(y) - 8 - horizon + 1):
            end = i + 8 + horizon - 1
            if strict and (t[end] - t[i]) / np.timedelta64(1, "h") != end - i:
                continue
            want[(s, pd.Timestamp(t[end]))] = (y[i:i + 8].tolist(), y[end])
    assert len(got) == len(want)
    for _, row in got.iterrows():
        x, y = want[(row["series_id"], row["time"])]
        assert [r[0] for r in row["window"]] == x and row["y"][0] == y


def test_windows_do_not_cross_the_split(spark):
    pdf = gappy(11, n=60, series=1)
    pdf["y"] = np.arange(60.0)
    labelled = windows.split_fraction(typed_frame(spark, pdf), SPEC, 0.8)
    got = windows.sliding_windows(labelled, SPEC, ["y"], ["y"], window=4, parts=("split",)).toPandas()
    assert got.groupby("split").size().to_dict() == {"train": 44, "test": 8}
    assert got[got["split"] == "test"]["y"].map(lambda v: v[0]).min() == 52.0


def test_holdout_and_short_series(spark):
    pdf = pd.concat([gappy(12, n=20, series=1), gappy(12, n=5, series=1).assign(series_id="short")])
    df = typed_frame(spark, pdf)
    got = windows.holdout_last(df, SPEC, 7).toPandas()
    assert got.groupby(["series_id", "split"]).size().to_dict() == {("s0", "test"): 7, ("s0", "train"): 13}
    assert [r["series_id"] for r in windows.too_short(df, SPEC, 7).collect()] == ["short"]


def test_lag_features_drop_incomplete_rows(spark):
    pdf = pd.DataFrame({"series_id": "a", "time": pd.date_range("2024-01-01", periods=10, freq="h")})
    for c in ("pm2_5", "pm10", "nitrogen_dioxide", "ozone"):
        pdf[c] = np.arange(10.0)
    got = windows.lag_features(typed_frame(spark, pdf), SPEC).toPandas().sort_values("time")
    assert len(got) == 8 and got["pm2_5_lag2"].tolist() == list(np.arange(8.0))
    with pytest.raises(ValueError, match="missing"):
        windows.lag_features(typed_frame(spark, pdf), SPEC, "absent")


def test_fill_sorts_each_block_once_in_a_stated_number_of_tasks(spark, capsys):
    filled = fill.fill_limited(typed_frame(spark, gappy(6)), SPEC, ["y"])
    filled.explain()
    by_time = [line for line in capsys.readouterr().out.splitlines() if "Sort [" in line and "time" in line]
    assert len(by_time) == 1
    # Partitions merged by compressed bytes would be one here, and would hold ever more rows of larger tables.
    assert filled.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_block_without_values_takes_its_neighbours_from_other_blocks(spark):
    pdf = gappy(7, n=20, series=1).assign(y=[1.0] + [np.nan] * 17 + [19.0, np.nan])
    got = values(fill.fill_time(typed_frame(spark, pdf), SPEC, ["y"]))
    np.testing.assert_allclose(got, [*np.arange(1.0, 20.0), 19.0])
