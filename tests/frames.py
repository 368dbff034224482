"""Frames that the tests start from."""

from __future__ import annotations

import numpy as np
import pandas as pd

from chronoloom.spec import POLLUTANTS, WEATHER


def hourly(n_past=60, n_future=24, seed=0, series="s1", keep_targets=False) -> pd.DataFrame:
    """An hourly upload: targets are unknown in the future part unless kept."""
    rng = np.random.default_rng(seed)
    n = n_past + n_future
    out = pd.DataFrame({"series_id": series, "time": pd.date_range("2024-01-01", periods=n, freq="h")})
    for c in POLLUTANTS:
        out[c] = rng.normal(20, 4, n)
        if not keep_targets:
            out.loc[n_past:, c] = np.nan
    out[WEATHER[0]] = rng.normal(10, 2, n)
    out[WEATHER[1]] = rng.normal(3.5, 0.5, n)
    return out


def as_text(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same frame as an upload of text cells."""
    out = pdf.copy()
    if out["time"].dtype.kind == "M":
        out["time"] = out["time"].dt.strftime("%Y-%m-%d %H:%M:%S") + "+00:00"
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = [None if np.isnan(v) else repr(float(v)) for v in out[c]]
    return out.astype(object)


def text_frame(spark, pdf: pd.DataFrame):
    shaped = as_text(pdf)
    schema = ", ".join(f"`{c}` string" for c in shaped.columns)
    return spark.createDataFrame([tuple(r) for r in shaped.itertuples(index=False)], schema)


def typed_frame(spark, pdf: pd.DataFrame):
    """Times as timestamp_ntz and NaN as NULL."""
    kinds = {"M": "timestamp_ntz", "f": "double", "i": "bigint", "O": "string"}
    schema = ", ".join(f"`{c}` {kinds[pdf[c].dtype.kind]}" for c in pdf.columns)
    rows = [
        tuple(
            None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in row
        )
        for row in pdf.astype(object).itertuples(index=False)
    ]
    return spark.createDataFrame(rows, schema)
