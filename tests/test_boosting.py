"""Pseudo-Huber boosting: leaf sums, losses and the chosen round against SQL over stored tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from frames import typed_frame
from pyspark.sql import functions as F
from test_training_and_stores import SMALL, wave

from chronoloom.plans import boosting, training

SETTINGS = boosting.BoostSettings(rounds=4, depth=3, patience=None, stored_every=2)


@pytest.fixture(scope="module")
def frames(spark):
    pdf = pd.concat([wave(n=260, series="a"), wave(n=230, series="b", seed=1)])
    return training.with_validation(training.training_frames(typed_frame(spark, pdf), SMALL), SMALL, 0.2)


@pytest.fixture(scope="module")
def model(frames):
    return boosting.train_boosted(frames, SMALL, SETTINGS)


def test_validation_is_the_end_of_training(frames):
    spans = frames.samples.groupBy("series_id", "split").agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.count("*").alias("n")).collect()
    got = {(r.series_id, r.split): r for r in spans}
    for s in "ab":
        assert got[s, "train"].hi < got[s, "valid"].lo and got[s, "valid"].hi < got[s, "test"].lo
        assert got[s, "valid"].n == pytest.approx(0.2 * (got[s, "train"].n + got[s, "valid"].n), abs=1)


def test_leaf_sums_and_values_by_sql(frames, model, tmp_path):
    """Round 1 from the rows, their leaves and the start alone."""
    for i, target in enumerate(SMALL.targets):
        rows = model.trees[i][0].added(frames.samples.filter("split = 'train'"), "leaf").filter(boosting._sampled(SMALL, 0, i, SETTINGS))
        rows.select(F.col("leaf").cast("int").alias("leaf"), F.col("y")[i].alias("y")).write.parquet(f"{tmp_path}/{target}")
        want = duckdb.sql(
            f"""WITH z AS (SELECT leaf, {model.start[i]!r} - y AS z FROM '{tmp_path}/{target}/*.parquet')
            SELECT leaf, sum(z / sqrt(1 + z * z)), sum((1 + z * z) ** -1.5),
              -0.05 * sum(z / sqrt(1 + z * z)) / (sum((1 + z * z) ** -1.5) + 1) FROM z GROUP BY 1 ORDER BY 1"""
        ).fetchall()
        got = sorted(x[2:] for x in model.leaves if x[0] == target and x[1] == 1)
        assert 2 <= len(got) <= 8
        np.testing.assert_allclose(got, want, rtol=1e-9)


def test_losses_and_choice_by_sql(spark, frames, model, tmp_path):
    told = {(r.target, r.round): (r.train_loss, r.valid_loss) for r in model.losses.collect()}
    assert len(told) == 2 * 5
    for rounds in (0, 2, 4):
        cut = boosting.BoostedTrees(model.start, model.trees, [rounds] * 2, model.losses, model.leaves)
        cut.margins(frames.samples).select("split", "margin", "y").write.parquet(f"{tmp_path}/{rounds}")
        for i, target in enumerate(SMALL.targets):
            want = duckdb.sql(
                f"""SELECT avg(l) FILTER (split = 'train'), avg(l) FILTER (split = 'valid')
                FROM (SELECT split, sqrt(1 + (margin[{i + 1}] - y[{i + 1}]) ** 2) - 1 AS l FROM '{tmp_path}/{rounds}/*.parquet')"""
            ).fetchall()[0]
            np.testing.assert_allclose(told[target, rounds], want, rtol=1e-9)
    chosen = {r.target: (r.best, r.best_loss) for r in boosting.chosen_rounds(model.losses).collect()}
    for i, target in enumerate(SMALL.targets):
        losses = [told[target, k][1] for k in range(5)]
        assert chosen[target] == (int(np.argmin(losses)), min(losses)) and model.best[i] == int(np.argmin(losses))
        assert losses[4] < losses[0] and told[target, 4][0] < told[target, 0][0]


def test_early_stop_and_predictions(frames, model):
    scored = training.evaluate(boosting.predict_boosted(frames, model, SMALL), SMALL)
    assert scored.count() == 2 and scored.filter("n > 0 AND mae > 0").count() == 2
    stopped = boosting.train_boosted(frames, SMALL, boosting.BoostSettings(rounds=6, depth=2, step=-0.5, patience=2, row_share=1.0))
    assert stopped.best == [0, 0] and [len(t) for t in stopped.trees] == [2, 2]
    assert stopped.margins(frames.samples).select("margin").distinct().count() == 1


def test_trees_stop_by_validation(frames):
    models = training.train_trees(frames, SMALL, training.TreeSettings(rounds=5, depth=2))
    assert all(1 <= m.getNumTrees <= 5 for m in models)
    assert training.evaluate(training.predict_samples(frames, models, SMALL), SMALL).count() == 2


def test_root_split_is_the_best_of_all_bins(frames, model):
    """All targets grow together in one job a level; the split of a root is the best that its rows and columns allow."""
    train = frames.samples.filter("split = 'train'")
    pdf = train.withColumns({f"used{i}": boosting._sampled(SMALL, 0, i, SETTINGS) for i in range(2)}).toPandas()
    cells = np.stack([v.toArray() for v in pdf.features])
    edges = boosting._edges(train, SETTINGS)
    for i in range(2):
        used = pdf[f"used{i}"].to_numpy()
        z = model.start[i] - np.stack(pdf.y)[used, i]
        g, h = z / np.sqrt(1 + z * z), (1 + z * z) ** -1.5
        gains = {}
        for c in np.flatnonzero(boosting._shown_columns(cells.shape[1], 0, i, SETTINGS)):
            for cut, edge in enumerate(edges[c]):
                left = cells[used, c] <= edge
                if left.any() and not left.all():
                    gains[c, cut] = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, ~left))
        tree = model.trees[i][0]
        assert gains[tree.column[0], tree.bin[0]] == pytest.approx(max(gains.values()), rel=1e-9)
        assert tree.threshold[0] == edges[tree.column[0]][tree.bin[0]]
