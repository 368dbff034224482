"""Correlations among many columns against numpy and against the form for few columns."""

from __future__ import annotations

import numpy as np
import pandas as pd

from chronoloom.operators import gram, stats


def wide(n=150, width=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(1000, 3, (n, 5)) @ rng.normal(0, 1, (5, width)) + rng.normal(0, 2, (n, width))
    x[rng.random((n, width)) < 0.1] = np.nan
    x[:, 7] = 5.5
    x[:, 8] = np.nan
    return x


def test_300_columns(spark):
    x = wide()
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(5)
    got = {(r.column_a, r.column_b): r["corr"] for r in gram.correlations_wide(df, names).collect()}
    assert len(got) == 300 * 300
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    for i in range(300):
        for j in range(300):
            v = got[names[i], names[j]]
            if 7 in (i, j) or 8 in (i, j):
                assert v is None
            else:
                assert abs(v - want[i, j]) < 1e-9


def test_keys_and_few_columns(spark, monkeypatch):
    monkeypatch.setattr(gram, "HELD", 100)
    x = wide(90, 9)
    names = [f"c{i}" for i in range(9)]
    pdf = pd.DataFrame(x, columns=names).assign(k=[f'k"{i % 3}' if i % 4 else None for i in range(90)], z=[i % 2 for i in range(90)])
    df = spark.createDataFrame(pdf).repartition(4)
    rows = [{(r.k, r.z, r.column_a, r.column_b): r["corr"] for r in f(df, names, ("k", "z")).collect()} for f in (gram.correlations_wide, stats.correlations)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == 7 * 81
    for key, v in rows[1].items():
        assert (v is None and rows[0][key] is None) or abs(v - rows[0][key]) < 1e-9, key
    assert gram.correlations_wide(df.limit(0), names, ("k",)).count() == 0
