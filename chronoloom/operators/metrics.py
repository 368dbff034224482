"""Forecast accuracy aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.stats import pearson

DENOMINATOR_FLOOR = 1e-8


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def smape(y: Column, p: Column) -> Column:
    """Symmetric error in percent; a zero denominator counts as a tiny one."""
    middle = (F.abs(y) + F.abs(p)) / 2
    return F.avg(F.abs(y - p) / F.greatest(middle, F.lit(DENOMINATOR_FLOOR))) * 100


def r2(y: Column, p: Column) -> Column:
    """Explained share of the variance; NULL where the truth does not vary."""
    scored = F.when(y.isNotNull() & p.isNotNull(), y)
    return 1 - F.sum(F.pow(y - p, F.lit(2.0))) / F.nullif(F.var_pop(scored) * F.count(scored), F.lit(0.0))


def accuracy(df: DataFrame, truth: str, predicted: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All measures over rows with a known truth and prediction, one row per key."""
    y, p = F.col(truth), F.col(predicted)
    scored = df.filter(y.isNotNull() & p.isNotNull())
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        smape(y, p).alias("smape"),
        r2(y, p).alias("r2"),
        pearson(y, p).alias("pearson_r"),
        F.stddev_pop(y).alias("sigma_true"),
        F.stddev_pop(p).alias("sigma_pred"),
    )


def best_candidate(scores: DataFrame, candidate: str, loss: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidate with the smallest loss; the first by name on a tie."""
    rank = F.struct(F.col(loss), F.col(candidate))
    known = scores.filter(F.col(loss).isNotNull())
    return known.groupBy(*keys).agg(
        F.min_by(candidate, rank).alias("best"), F.min(loss).alias("best_loss")
    )
