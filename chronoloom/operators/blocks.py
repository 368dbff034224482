"""Ordered work on series of any length.

A window partitioned by the series alone puts a whole series into one task, and
one series may hold a third of all rows.  Here a series is cut into blocks of
``spec.block_rows`` clock ticks.  Rows are shuffled on ``(series, block)``; what
has to cross a block edge is carried by one summary row per block, or by a halo
of a few rows copied into the next block.  A calendar holds a limited number of
blocks per series, so the windows over summary rows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.spec import PanelSpec

BLOCK = "_block"
POSITION = "_pos"
LENGTH = "_len"


def time_block(spec: PanelSpec) -> Column:
    return clock.ticks(F.col(spec.time), spec.cadence_seconds * spec.block_rows)


def in_block(spec: PanelSpec):
    return Window.partitionBy(spec.key, BLOCK).orderBy(F.col(spec.time).asc())


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled on ``keys`` into a stated number of partitions.

    Spark merges partitions by their compressed bytes, and NULL cells and ticks of a clock compress to almost nothing:
    a merged partition would hold more and more rows to sort as the data grows.  A stated number is not merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_block(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with their block, shuffled on (series, block).

    The shuffle is explicit: rows that come from a join on the series are already together by series, and Spark would
    take that for good enough, so a series would be one task again.
    """
    if BLOCK in df.columns:  # already together by block
        return df
    return dealt(df.withColumn(BLOCK, time_block(spec)), spec.key, BLOCK)


def block_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per block: how many rows the series has before it, in it and in all."""
    ordered = Window.partitionBy(spec.key).orderBy(BLOCK)
    return (
        df.select(spec.key, time_block(spec).alias(BLOCK))
        .groupBy(spec.key, BLOCK)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(ordered) - F.col("_rows"))
        .withColumn(LENGTH, F.sum("_rows").over(Window.partitionBy(spec.key)))
    )


def with_positions(df: DataFrame, spec: PanelSpec, keep_block: bool = False) -> DataFrame:
    """Add the 0-based row position in time order and the row count of the series.

    With ``keep_block`` the block stays as a column, and the next ordered operator finds its rows already shuffled.
    """
    inside = by_block(df, spec).withColumn(
        POSITION, F.row_number().over(in_block(spec)).cast("bigint") - 1
    )
    counts = block_counts(df, spec).select(spec.key, BLOCK, "_before", LENGTH)
    return (
        inside.join(counts, [spec.key, BLOCK])
        .withColumn(POSITION, F.col(POSITION) + F.col("_before"))
        .drop("_before", *([] if keep_block else [BLOCK]))
    )


def time_at_position(df: DataFrame, spec: PanelSpec, position: Column, name: str) -> DataFrame:
    """Per series, the time of the row at ``position`` (an expression over the row count).

    Only block counts and the rows of one block per series are ordered; the
    other rows are never shuffled.
    """
    counts = block_counts(df, spec).withColumn("_want", position.cast("bigint"))
    hit = counts.filter(
        (F.col("_want") >= F.col("_before")) & (F.col("_want") < F.col("_before") + F.col("_rows"))
    ).select(spec.key, BLOCK, (F.col("_want") - F.col("_before")).alias("_offset"), LENGTH)
    rows = df.select(spec.key, spec.time, time_block(spec).alias(BLOCK)).join(hit, [spec.key, BLOCK])
    return (
        rows.withColumn("_rank", F.row_number().over(in_block(spec)) - 1)
        .filter(F.col("_rank") == F.col("_offset"))
        .select(spec.key, F.col(spec.time).alias(name), LENGTH)
    )


def with_halo(df: DataFrame, step: Column, size: int, before: int, after: int = 0) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block.

    ``step`` is a whole-number coordinate.  Block ``b`` owns steps ``b*size`` up
    to ``(b+1)*size``; it also receives ``before`` steps from the left and
    ``after`` steps from the right, with ``_own`` false.  Both must be at most
    ``size``, so a row has at most three copies.
    """
    if max(before, after) > size:
        raise ValueError("A halo may not be longer than a block.")
    home = clock.floor_div(step, size)
    inner = step - home * size
    no_block = F.lit(None).cast("bigint")
    copies = F.array_compact(
        F.array(
            home,
            F.when(inner >= size - before, home + 1).otherwise(no_block),
            F.when(inner < after, home - 1).otherwise(no_block),
        )
    )
    return (
        df.withColumn("_home", home)
        .withColumn(BLOCK, F.explode(copies))
        .withColumn("_own", F.col(BLOCK) == F.col("_home"))
        .drop("_home")
    )


def spine(bounds: DataFrame, spec: PanelSpec, first: str, last: str) -> DataFrame:
    """Every clock tick from ``first`` to ``last`` for each row of ``bounds``.

    Ticks are made in two steps (blocks, then ticks inside a block), so a long
    series never becomes one long array.
    """
    size = spec.cadence_seconds
    long = spec.block_rows
    lo = clock.ticks(F.col(first), size)
    hi = clock.ticks(F.col(last), size)
    blocks = bounds.select(
        spec.key,
        lo.alias("_lo"),
        hi.alias("_hi"),
        F.explode(F.sequence(clock.floor_div(lo, long), clock.floor_div(hi, long))).alias(BLOCK),
    )
    start = F.greatest(F.col("_lo"), F.col(BLOCK) * long)
    end = F.least(F.col("_hi"), F.col(BLOCK) * long + (long - 1))
    return dealt(blocks, spec.key, BLOCK).select(
        spec.key, F.explode(F.sequence(start, end)).alias("_tick")
    ).select(spec.key, clock.from_epoch_seconds(F.col("_tick") * size).alias(spec.time))
