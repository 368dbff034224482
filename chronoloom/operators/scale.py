"""Z-score and min-max scaling with statistics fitted on chosen rows (F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.spec import SIGMA_FLOOR


def safe_sigma(sigma: Column) -> Column:
    """A spread too small to divide by counts as 1."""
    return F.when(sigma < SIGMA_FLOOR, F.lit(1.0)).otherwise(sigma)


def fit_zscore(df: DataFrame, cols, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation per column, one row per key (one row with no key)."""
    stats = [F.avg(c).alias(f"{c}_mu") for c in cols]
    stats += [safe_sigma(F.stddev_pop(c)).alias(f"{c}_sigma") for c in cols]
    return df.groupBy(*keys).agg(*stats)


def fit_minmax(df: DataFrame, cols, keys: tuple[str, ...] = ()) -> DataFrame:
    """Minimum and range per column; a constant column has range 1."""
    out = []
    for c in cols:
        width = F.max(c) - F.min(c)
        out += [F.min(c).alias(f"{c}_min"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias(f"{c}_range")]
    return df.groupBy(*keys).agg(*out)


def attach(df: DataFrame, stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Put the fitted statistics next to every row.

    Keyed statistics are an ordinary equi-join, broadcast only when small at
    run time.  Statistics without a key are one row, read as a scalar subquery.
    """
    if keys:
        return df.join(stats, list(keys))
    row = stats.select(F.struct("*").alias("row")).scalar()
    return df.withColumn("_stats", row).select(*df.columns, "_stats.*")


def apply_zscore(df: DataFrame, stats: DataFrame, cols, keys: tuple[str, ...] = ()) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sigma") for c in cols}
    return attach(df, stats, keys).withColumns(scaled).select(*df.columns)


def invert_zscore(
    df: DataFrame, stats: DataFrame, renames: dict[str, str], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Back to original units; ``renames`` maps a scaled column to the column it was fitted on."""
    raw = {c: F.col(c) * F.col(f"{f}_sigma") + F.col(f"{f}_mu") for c, f in renames.items()}
    return attach(df, stats, keys).withColumns(raw).select(*df.columns)


def apply_minmax(df: DataFrame, stats: DataFrame, cols, keys: tuple[str, ...] = ()) -> DataFrame:
    """To the fitted range, without clipping rows outside it."""
    scaled = {c: (F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range") for c in cols}
    return attach(df, stats, keys).withColumns(scaled).select(*df.columns)
