"""Exact quantiles without sorting or collecting a group.

The built-in exact percentile keeps every distinct value of a group in one
task.  Here the wanted ranks are located by counting: first in buckets on a
signed logarithmic scale, then in equal-width parts of the buckets hit, and only
the rows of those parts are counted value by value.  All counts combine on the
map side, so a value held by many rows costs one row.  The bucket functions
never decrease, so the ranks are exact whatever the distribution.

What one window task orders is bounded by the number format alone: a group has
at most ``PER_OCTAVE`` buckets for each power of two that its values span, a
bucket ``PARTS`` parts, and an octave 2**52 doubles, so the values counted one
by one are about 2**52 / PER_OCTAVE / PARTS = 2**20 a part, however many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 1 << 14
PARTS = 1 << 18
#: Levels run from -1074 to 1023 octaves; the shift makes them positive.
_SHIFT = 1 << 25
_INFINITE = 1 << 27


def _coarse(value: Column) -> Column:
    size = F.abs(value)
    level = F.when(size == float("inf"), F.lit(_INFINITE)).otherwise(
        F.floor(F.log2(size) * PER_OCTAVE) + _SHIFT
    )
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * level).cast("bigint")


def _fine(value: Column, lo: Column, hi: Column) -> Column:
    part = F.floor((value - lo) / (hi - lo) * PARTS)
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(part, F.lit(PARTS - 1))).cast("bigint")


def _locate(counts: DataFrame, within: list[str], order: str, wanted: str) -> DataFrame:
    """Keep the bucket each wanted rank falls in; ``_skip`` counts the rows before it."""
    ordered = Window.partitionBy(*within).orderBy(order)
    return (
        counts.withColumn("_skip", F.sum("_n").over(ordered) - F.col("_n"))
        .withColumn(wanted, F.explode(wanted))
        .filter((F.col(wanted) >= F.col("_skip")) & (F.col(wanted) < F.col("_skip") + F.col("_n")))
    )


def exact_quantiles(
    long: DataFrame, groups: list[str], probabilities: list[float], value: str = "value", few: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group, columns ``q0``, ``q1``, ...

    NULL values are ignored; a group without values has no row.  ``few`` says that the groups are a handful whatever the
    number of rows: what was located, at most two buckets per group and probability, then goes to the rows.  Otherwise the
    rows of a bucket that many share, as those of a column with few values, would meet it in one task.
    """
    handed = F.broadcast if few else lambda located: located
    rows = long.select(*groups, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    coarse = rows.withColumn("_c", _coarse(F.col("_v")))

    # Step 1: which coarse bucket holds each wanted rank.
    counted = coarse.groupBy(*groups, "_c").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    total = F.sum("_n").over(whole)
    spots = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
    ranks = F.array_distinct(
        F.array(*[f(s).cast("bigint") for s in spots for f in (F.floor, F.ceil)])
    )
    base = groups or ["_all"]
    if not groups:
        counted = counted.withColumn("_all", F.lit(0))
        coarse = coarse.withColumn("_all", F.lit(0))
    first = _locate(
        counted.withColumn("_total", total).withColumn("_rank", ranks), base, "_c", "_rank"
    )
    buckets = first.groupBy(*base, "_c").agg(
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        F.collect_set(F.col("_rank") - F.col("_skip")).alias("_inner"),
    )

    # Step 2: which equal-width part of that bucket.
    fine = coarse.join(handed(buckets), [*base, "_c"]).withColumn(
        "_f", _fine(F.col("_v"), F.col("_lo"), F.col("_hi"))
    )
    parts = fine.groupBy(*base, "_c", "_f").agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_plo"),
        F.max("_v").alias("_phi"),
        F.first("_inner").alias("_inner"),
    )
    second = _locate(parts, [*base, "_c"], "_f", "_inner").select(
        *base, "_c", "_f", "_plo", "_phi", "_inner", "_skip"
    )
    segments = second.groupBy(*base, "_c", "_f").agg(
        F.first("_plo").alias("_plo"),
        F.first("_phi").alias("_phi"),
        F.first("_skip").alias("_part_skip"),
        F.collect_set(F.col("_inner") - F.col("_skip")).alias("_deep"),
    )

    # Step 3: count the values of those parts one by one.
    values = (
        coarse.join(handed(segments), [*base, "_c"])
        .filter(F.col("_v").between(F.col("_plo"), F.col("_phi")))
        .groupBy(*base, "_c", "_f", "_v")
        .agg(
            F.count("*").alias("_n"),
            F.first("_deep").alias("_deep"),
            F.first("_part_skip").alias("_part_skip"),
        )
    )
    found = _locate(values, [*base, "_c", "_f"], "_v", "_deep").select(
        *base, "_c", (F.col("_deep") + F.col("_part_skip")).alias("_at"), "_v"
    )

    # Back to ranks of the whole group, then interpolate.
    by_rank = first.select(*base, "_c", "_rank", "_total", (F.col("_rank") - F.col("_skip")).alias("_at"))
    picked = (
        by_rank.join(found, [*base, "_c", "_at"])
        .groupBy(*base)
        .agg(
            F.max("_total").alias("_total"),
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"),
        )
    )

    def at(p: float) -> Column:
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.col("_values")[F.floor(spot).cast("bigint")]
        high = F.col("_values")[F.ceil(spot).cast("bigint")]
        return F.when(low == high, low).otherwise(low + (high - low) * (spot - F.floor(spot)))

    return picked.select(*groups, *[at(p).alias(f"q{i}") for i, p in enumerate(probabilities)])
