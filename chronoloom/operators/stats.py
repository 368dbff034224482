"""Exploratory statistics (E1-E8), over all rows or per key."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import coerce
from chronoloom.operators import schema
from chronoloom.operators.quantiles import exact_quantiles

# Names tried, in order, for the time column of an overview.
TIME_NAMES = ("time", "timestamp", "datetime", "date")


def known(c: Column) -> Column:
    """The value as a double; NaN is a missing value like NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_long(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), name: str = "column") -> DataFrame:
    """One row per cell: keys, column name, value as double; NULLs kept, and NaN is NULL."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), known(F.col(c)).alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def _handed(small: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per column and key, to be joined with cells: without keys it goes to them, as a column's cells would be one task."""
    return small if keys else F.broadcast(small)


def _with_quantiles(long: DataFrame, groups: list[str], aggs: list[Column], probabilities: list[float], few: bool) -> DataFrame:
    plain = long.groupBy(*groups).agg(*aggs)
    return plain.join(exact_quantiles(long, groups, probabilities, few=few), groups, "left")


def statistical_summary(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, minimum, maximum and sample deviation per column."""
    groups = [*keys, "pollutant"]
    aggs = [
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"),
    ]
    out = _with_quantiles(to_long(df, columns, keys, "pollutant"), groups, aggs, [0.5], not keys)
    return out.select(*groups, "mean", F.col("q0").alias("median"), "min", "max", "std")


def missing_report(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Count of missing values (NULL or NaN) per column."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def missing(c: str) -> Column:
        floating = isinstance(types[c], (T.DoubleType, T.FloatType))
        return (known(F.col(c)) if floating else F.col(c)).isNull()

    counted = df.groupBy(*keys).agg(*[F.count_if(missing(c)).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in columns])
    return counted.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def iqr_outliers(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and share of values outside the 1.5-IQR fences."""
    groups = [*keys, "column"]
    long = to_long(df, columns, keys)
    q = exact_quantiles(long, groups, [0.25, 0.75], few=not keys).select(
        *groups,
        (F.col("q0") - 1.5 * (F.col("q1") - F.col("q0"))).alias("_low"),
        (F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("_high"),
    )
    outside = (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))
    counted = long.join(_handed(q, keys), groups, "left").groupBy(*groups).agg(
        F.count_if(outside).alias("outlier_count"), F.count("value").alias("_n")
    )
    share = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("outlier_count") * 100.0 / F.col("_n"))
    return counted.select(*groups, "outlier_count", share.alias("outlier_pct"))


def seasonal_month(df: DataFrame, time: str, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means by calendar month, pooled over years."""
    return df.groupBy(*keys, F.month(time).alias("month")).agg(*[F.avg(c).alias(c) for c in columns])


def seasonal_hour(df: DataFrame, time: str, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means by hour of day, pooled over days."""
    return df.groupBy(*keys, F.hour(time).alias("hour")).agg(*[F.avg(c).alias(c) for c in columns])


def describe(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column (E5)."""
    groups = [*keys, "column"]
    aggs = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    out = _with_quantiles(to_long(df, columns, keys), groups, aggs, [0.25, 0.5, 0.75], not keys)
    return out.select(
        *groups, "count", "mean", "std", "min",
        F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max",
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; NULL when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def correlations(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairwise-complete correlation matrix in long form.

    Each unordered pair is aggregated once, all pairs in a single pass.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(
        *[pearson(known(F.col(a)), known(F.col(b))).alias(f"{a}|{b}") for a, b in pairs]
    )
    index = {c: i for i, c in enumerate(columns)}

    def cell(a: str, b: str) -> Column:
        x, y = (a, b) if index[a] <= index[b] else (b, a)
        return F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{x}|{y}`").alias("corr")
        )

    cells = F.array(*[cell(a, b) for a, b in product(columns, repeat=2)])
    return wide.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")


def histogram(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Equal-width bins, between 10 and 60 of them by the root of the row count.

    Empty bins have no row; the maximum belongs to the last bin.
    """
    groups = [*keys, "column"]
    long = to_long(df, columns, keys).filter(F.col("value").isNotNull())
    bounds = long.groupBy(*groups).agg(
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.least(F.lit(60), F.greatest(F.lit(10), F.floor(F.sqrt(F.count("value"))))).cast("int").alias("bins"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width) + 1, F.col("bins"))
    )
    binned = long.join(_handed(bounds, keys), groups).withColumn("bin", place.cast("int"))
    counted = binned.groupBy(*groups, "bins", "bin", "_lo", "_hi").agg(F.count("*").alias("count"))
    return counted.select(
        *groups, "bins", "bin",
        (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * width).alias("bin_end"),
        "count",
    )


def overview(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows, first and last day of the first time-like column, number of numeric columns."""
    shaped = schema.drop_geo(df)
    time = next((c for c in TIME_NAMES if c in shaped.columns), None)
    if time is None:
        day = F.lit(None).cast("date")
    elif isinstance(shaped.schema[time].dataType, T.StringType):
        # An unreadable text date counts as no date.
        day = coerce.parse_utc(F.col(time)).cast("date")
    else:
        day = F.to_date(F.col(time))
    n_numeric = len(schema.numeric_columns(shaped, keys))
    return shaped.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.lit(n_numeric).alias("numeric_columns"),
    )
