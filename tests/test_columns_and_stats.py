"""Coercion, schema, labels, quantiles, statistics and scaling."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from frames import typed_frame
from pyspark.sql import functions as F

from chronoloom.functions import clock, coerce, labels
from chronoloom.operators import combine, metrics, scale, schema, stats
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.spec import AIR_QUALITY, PanelSpec, PanelValidationError

SPEC = PanelSpec(targets=("y",), drivers=())


def test_numbers(spark):
    texts = ["1.5", " 2 ", "-1e3", ".5", "1d", "abc", "NaN", "", None, "inf", "-Infinity", "1,5"]
    df = spark.createDataFrame([(t,) for t in texts], "y string")
    got = [r[0] for r in coerce.numeric(df, ["y"]).collect()]
    assert got == [1.5, 2.0, -1000.0, 0.5, None, None, None, None, None, np.inf, -np.inf, None]


def test_lenient_times_ignore_the_session_zone(spark):
    texts = {
        "2024-03-31 02:30:00": "2024-03-31 02:30:00",
        "2024-03-31T02:30:00.250+02:00": "2024-03-31 00:30:00.25",
        "2024-01-05": "2024-01-05 00:00:00",
        "01/05/2024 13:45": "2024-01-05 13:45:00",
        "2024/01/05 13:45:01": "2024-01-05 13:45:01",
        "2024-01-05T00:00:00Z": "2024-01-05 00:00:00",
        "2024-01-05 00:00:00-0530": "2024-01-05 05:30:00",
        "12:30": None, "2024": None, "not-a-date": None, "2024-13-45": None,
    }
    df = spark.createDataFrame([(k,) for k in texts], "time string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            rows = df.withColumn("raw", F.col("time")).transform(lambda d: coerce.parse_time_lenient(d, SPEC))
            got = {r["raw"]: r["t"] for r in rows.select("raw", F.col("time").cast("string").alias("t")).collect()}
            want = {k: v for k, v in texts.items()}
            assert {k: pd.Timestamp(v) if v else None for k, v in got.items()} == {
                k: pd.Timestamp(v) if v else None for k, v in want.items()
            }
            back = rows.select(
                "raw", "time", clock.from_epoch_seconds(clock.epoch_seconds(F.col("time"))).alias("again")
            ).filter("time IS NOT NULL").collect()
            assert all(r["again"] == r["time"].replace(microsecond=0) for r in back)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_strict_times_follow_the_first_row(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-02"), ("b", 1, "2024-01-02"), ("b", 2, "x")]
    df = spark.createDataFrame(rows, "series_id string, n int, time string")
    got = coerce.parse_time_strict(df, SPEC, "n").orderBy("series_id", "n").collect()
    assert [r["time"] for r in got] == [dt.datetime(2024, 1, 1), None, dt.datetime(2024, 1, 2), None]


def test_iso_and_negative_epoch(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '1969-12-31 23:00:00.5' AS a, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS b")
    row = df.select(
        clock.iso_utc(F.col("a")).alias("x"), clock.iso_utc(F.col("b")).alias("y"),
        clock.epoch_seconds(F.col("a")).alias("s"), clock.ticks(F.col("a"), 3600).alias("k"),
        clock.hours_between(F.col("a"), F.col("b")).alias("h"),
    ).first()
    assert row["x"] == "1969-12-31T23:00:00.500000+00:00" and row["y"] == "2024-01-01T00:00:00+00:00"
    assert (row["s"], row["k"]) == (-3600, -1)
    assert row["h"] == pytest.approx((dt.datetime(2024, 1, 1) - dt.datetime(1969, 12, 31, 23, 0, 0, 500000)).total_seconds() / 3600)


def test_schema_shaping(spark):
    geo = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "a int, Latitude int, longitude int, ` lat ` int, Lng int, lon int")
    assert schema.drop_geo(geo).columns == ["a"]
    with pytest.raises(PanelValidationError, match="only in case"):
        schema.normalise_names(spark.createDataFrame([(1, 2)], "`A ` int, b int").withColumnRenamed("b", "a "))
    part = spark.createDataFrame([("2024-01-01", 5.0)], "Time string, PM2_5 double")
    row = schema.expected_schema(part, AIR_QUALITY).first()
    assert row["pm2_5"] == 5.0 and row["ozone"] == 0.0 and row["city"] == "unknown" and row["source"] == "uploaded"
    with pytest.raises(PanelValidationError, match="pm10, ozone"):
        schema.require_columns(spark.range(1), ("pm10", "ozone"), "past")
    assert schema.align(part, ["b", "PM2_5"], ("Time",)).first()[1:] == (0.0, 5.0)
    assert schema.reindex(part, ["b"], ("Time",)).first()["b"] is None
    assert schema.keep_numeric(part).columns == ["PM2_5"]


def test_live_row_wins(spark):
    up = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 01:00:00", 2.0)], "time string, pm2_5 double")
    live = spark.createDataFrame([("2024-01-01 01:00:00", 99.0), ("bad", 1.0)], "time string, pm2_5 double")
    got = combine.combine_sources(up, live, AIR_QUALITY).orderBy("time").collect()
    assert [(r["pm2_5"], r["source"]) for r in got] == [(1.0, "uploaded"), (99.0, "live_api")]
    with pytest.raises(PanelValidationError):
        combine.combine_sources(None, None, AIR_QUALITY)


def test_bands_json_labels(spark):
    df = spark.createDataFrame([(12.0,), (12.1,), (35.4,), (36.0,), (None,)], "pm2_5_pred double")
    got = [r["pm25_safety_level"] for r in labels.with_safety_band(df).collect()]
    assert got == ["Low", "Moderate", "Moderate", "High", "High"]
    texts = spark.createDataFrame([('{"a": 1}',), ("broken {",), (None,)], "t string")
    out = [r[0] for r in texts.select(labels.readable_json(F.col("t"))).collect()]
    assert out[0] == '{"a": 1}' and json.loads(out[1]) == {"raw": "broken {"} and out[2] is None
    names = spark.createDataFrame([("ARIMA",), ("x",), (" XGBoost ",), (None,)], "m string")
    assert [r[0] for r in names.select(labels.model_label(F.col("m"))).collect()] == ["LSTM", "LSTM", "XGBoost", "LSTM"]
    assert [r[0] for r in names.select(labels.stored_label(F.col("m"))).collect()] == ["LSTM", "x", "XGBoost", "LSTM"]


@pytest.mark.parametrize("kind", ["normal", "heavy", "copies", "tiny", "constant", "infinite"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    data = {
        "normal": rng.normal(0, 1, 4001),
        "heavy": np.concatenate([np.exp(rng.normal(0, 30, 2000)), -np.exp(rng.normal(0, 30, 2000))]),
        "copies": np.concatenate([np.full(3000, 7.25), rng.normal(7.25, 1e-9, 1500), np.zeros(10)]),
        "tiny": np.array([3.0, -1.0]),
        "constant": np.full(50, -2.5),
        "infinite": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf, np.inf]),
    }[kind]
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([("g", float(v)) for v in data] + [("g", None)], "k string, value double")
    row = exact_quantiles(df, ["k"], probs).first()
    pandas_says = pd.Series(data).quantile([0.25, 0.5] if kind == "infinite" else probs)
    for p, want in pandas_says.items():
        assert row[f"q{probs.index(p)}"] == pytest.approx(want, rel=1e-12, abs=1e-300)
    overall = exact_quantiles(df, [], [0.5]).first()
    assert overall["q0"] == row["q2"]


def test_statistics(spark):
    pdf = pd.DataFrame({"a": [1, 1, 1, 1, 1, 100.0], "b": [0.0] * 6, "n": [np.nan] * 6, "c": [1, np.nan, 3, 4, 5, 9.0]})
    df = typed_frame(spark, pdf)
    out = {r["column"]: (r["outlier_count"], round(r["outlier_pct"], 6)) for r in stats.iqr_outliers(df, ["a", "b", "n"]).collect()}
    assert out == {"a": (1, round(100 / 6, 6)), "b": (0, 0.0), "n": (0, 0.0)}
    miss = {r["column"]: r["missing_count"] for r in stats.missing_report(df, ["a", "n", "c"]).collect()}
    assert miss == {"a": 0, "n": 6, "c": 1}
    corr = {(r["column_a"], r["column_b"]): r["corr"] for r in stats.correlations(df, ["a", "b", "c"]).collect()}
    assert corr[("a", "b")] is None and corr[("b", "b")] is None
    assert corr[("a", "c")] == pytest.approx(pdf["a"].corr(pdf["c"])) == corr[("c", "a")]
    desc = stats.describe(df, ["c", "n"]).toPandas().set_index("column")
    want = pdf["c"].describe()
    np.testing.assert_allclose(
        desc.loc["c", ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float), want.to_numpy()
    )
    assert desc.loc["n", "count"] == 0 and pd.isna(desc.loc["n", "p50"])
    hist = stats.histogram(df, ["a"]).toPandas().sort_values("bin")
    assert hist["bin"].tolist() == [1, 10] and hist["count"].tolist() == [5, 1]


def test_scaling(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [5.0] * 4, "part": ["t", "t", "t", "x"]})
    df = typed_frame(spark, pdf)
    mm = scale.apply_minmax(df, scale.fit_minmax(df.filter("part = 't'"), ["a", "b"]), ["a", "b"]).toPandas()
    assert mm["a"].tolist() == [0.0, 0.5, 1.0, 1.5] and mm["b"].tolist() == [0.0] * 4
    fitted = scale.fit_zscore(df, ["a", "b"])
    z = scale.apply_zscore(df, fitted, ["a", "b"])
    np.testing.assert_allclose(z.toPandas()["a"], (pdf["a"] - 2.5) / pdf["a"].std(ddof=0))
    assert z.toPandas()["b"].tolist() == [0.0] * 4
    np.testing.assert_allclose(scale.invert_zscore(z, fitted, {"a": "a"}).toPandas()["a"], pdf["a"])
    tiny = spark.createDataFrame([(0.0,), (1e-12,), (1.0,), (5.0,)], "s double")
    assert [r[0] for r in tiny.select(scale.safe_sigma(F.col("s"))).collect()] == [1.0, 1.0, 1.0, 5.0]


def test_metrics_on_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 3.0)], "y double, p double")
    row = metrics.accuracy(df, "y", "p").first()
    assert (row["n"], row["mae"], row["rmse"]) == (2, 1.0, 1.0) and row["r2"] is None and row["pearson_r"] is None
    zero = spark.createDataFrame([(0.0, 0.0)], "y double, p double")
    assert metrics.accuracy(zero, "y", "p").first()["smape"] == 0.0


@pytest.mark.parametrize("work", [stats.describe, stats.statistical_summary, stats.histogram, stats.iqr_outliers])
def test_cells_of_a_column_are_not_gathered_in_one_task(spark, work):
    """Only counts are shuffled on the column; cells, of which a column has as many as there are rows, never are."""
    df = spark.range(2000).selectExpr("id % 3 AS a", "id * 0.5 AS b")
    text = work(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    joined = text.count("Join Inner") + text.count("Join LeftOuter")
    assert joined and text.count("(strategy=broadcast)") >= (2 if work in (stats.describe, stats.statistical_summary) else 1)
