"""Lags, differences, splits and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.operators import blocks
from chronoloom.operators.blocks import BLOCK, LENGTH, POSITION
from chronoloom.spec import PanelSpec, PanelValidationError

# Fixed value: columns that get a lag of one row next to the target's lags.
LAGGED_COMPANIONS = ("pm10", "nitrogen_dioxide", "ozone")


def with_lags(
    df: DataFrame, spec: PanelSpec, lags: dict[str, tuple[str, int]], regular: bool = False
) -> DataFrame:
    """Add ``name -> (column, n)`` lags in row order; short series give NULLs.

    Rows are placed by position, so gaps in time do not matter.  On a
    ``regular`` panel (every tick present) the tick number places them and the
    counting pass is saved.
    """
    depth = max(n for _, n in lags.values())
    size = max(spec.block_rows, depth)
    if regular:
        placed = df.withColumn(POSITION, clock.ticks(F.col(spec.time), spec.cadence_seconds))
    else:
        placed = blocks.with_positions(df, spec).drop(LENGTH)
    haloed = blocks.with_halo(placed, F.col(POSITION), size, before=depth)
    ordered = Window.partitionBy(spec.key, BLOCK).orderBy(POSITION)
    return (
        haloed.withColumns({name: F.lag(c, n).over(ordered) for name, (c, n) in lags.items()})
        .filter("_own")
        .select(*df.columns, *lags)
    )


def lag_features(df: DataFrame, spec: PanelSpec, target: str = "pm2_5", regular: bool = False) -> DataFrame:
    """Lags 1 and 2 of the target, lag 1 of its companions, complete rows only."""
    if target not in df.columns:
        raise PanelValidationError(f"The target column is missing: {target}")
    lags = {f"{target}_lag1": (target, 1), f"{target}_lag2": (target, 2)}
    lags.update({f"{c}_lag1": (c, 1) for c in LAGGED_COMPANIONS if c in df.columns})
    return with_lags(df, spec, lags, regular).na.drop("any")


def time_steps(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each row with the previous time of its series and the step in hours.

    Inside a block the previous row is at hand; the first row of a block takes
    the last time of the nearest earlier block.
    """
    keyed = blocks.by_block(df, spec)
    earlier = Window.partitionBy(spec.key).orderBy(BLOCK)
    ends = (
        keyed.groupBy(spec.key, BLOCK)
        .agg(F.max(spec.time).alias("_end"))
        .select(spec.key, BLOCK, F.lag("_end").over(earlier).alias("_carried"))
    )
    return (
        keyed.withColumn("previous", F.lag(spec.time).over(blocks.in_block(spec)))
        .join(ends, [spec.key, BLOCK])
        .withColumn("previous", F.coalesce("previous", "_carried"))
        .withColumn("step_hours", clock.hours_between(F.col("previous"), F.col(spec.time)))
        .drop(BLOCK, "_carried")
    )


def newest_rows(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Last ``n`` rows of every series.

    The rank filter lets Spark keep at most ``n`` rows per series in each map
    task, so a long series reaches its window already cut.
    """
    return _ranked(df, spec, n, F.col(spec.time).desc())


def oldest_rows(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """First ``n`` rows of every series."""
    return _ranked(df, spec, n, F.col(spec.time).asc())


def _ranked(df: DataFrame, spec: PanelSpec, n: int, order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(spec.key).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def holdout_last(df: DataFrame, spec: PanelSpec, n: int) -> DataFrame:
    """Label each row ``train`` or ``test``, the last ``n`` rows being the test.

    Series with ``n`` rows or fewer are left out; :func:`too_short` lists them.
    Only the start of the test block is joined, so the rows are not shuffled
    for their order.
    """
    start = newest_rows(df.select(spec.key, spec.time), spec, n + 1).groupBy(spec.key).agg(
        F.min(spec.time).alias("_last_train"), F.count("*").alias("_kept")
    )
    usable = start.filter(F.col("_kept") > n).select(spec.key, "_last_train")
    label = F.when(F.col(spec.time) <= F.col("_last_train"), "train").otherwise("test")
    return df.join(usable, spec.key).withColumn("split", label).drop("_last_train")


def too_short(df: DataFrame, spec: PanelSpec, n: int, among: DataFrame | None = None) -> DataFrame:
    """Series that cannot give up ``n`` rows for a test; with ``among`` also its series that have no row at all."""
    counts = df.groupBy(spec.key).agg(F.count("*").alias("rows"))
    if among is not None:
        counts = among.select(spec.key).distinct().join(counts, spec.key, "left").fillna(0, ["rows"])
    return counts.filter(F.col("rows") <= n)


def split_fraction(df: DataFrame, spec: PanelSpec, fraction: float = 0.8) -> DataFrame:
    """Label the first ``floor(rows * fraction)`` rows ``train``, the rest ``test``."""
    first_test = F.floor(F.col(LENGTH) * F.lit(fraction))
    edge = blocks.time_at_position(df, spec, first_test, "_first_test").drop(LENGTH)
    label = F.when(F.col(spec.time) < F.col("_first_test"), "train").otherwise("test")
    return df.join(edge, spec.key).withColumn("split", label).drop("_first_test")


def sliding_windows(
    df: DataFrame,
    spec: PanelSpec,
    features: list[str] | tuple[str, ...],
    targets: list[str] | tuple[str, ...],
    window: int | None = None,
    horizon: int = 1,
    parts: tuple[str, ...] = (),
    strict_time: bool = False,
) -> DataFrame:
    """Windows of ``window`` rows with the target row ``horizon`` rows after.

    Windows follow row order and may straddle time gaps unless ``strict_time``
    is set.  ``parts`` names extra columns (a train/test label) no window
    crosses.  Output: key, parts, time of the target row, ``window`` as an array
    of feature rows, ``y`` as an array of targets.
    """
    size_w = spec.window if window is None else window
    keys = [spec.key, *parts]
    frame = df.select(*keys, spec.time, F.array(*features).alias("_x"), F.array(*targets).alias("_y"))
    placed = _positions_by(frame, spec, parts)
    size = max(spec.block_rows, size_w, horizon)
    haloed = blocks.with_halo(placed, F.col(POSITION), size, before=size_w, after=horizon - 1)
    ordered = Window.partitionBy(*keys, BLOCK).orderBy(POSITION)
    ahead = horizon - 1
    built = (
        haloed.withColumn("window", F.collect_list("_x").over(ordered.rowsBetween(-size_w, -1)))
        .withColumn("_start", F.first(spec.time).over(ordered.rowsBetween(-size_w, -1)))
        .withColumn("y", F.lead("_y", ahead).over(ordered))
        .withColumn("_target_time", F.lead(spec.time, ahead).over(ordered))
        .filter(F.col("_own") & (F.size("window") == size_w) & F.col("y").isNotNull())
    )
    if strict_time:
        span = spec.cadence_seconds * (size_w + ahead)
        built = built.filter(
            clock.epoch_seconds(F.col("_target_time")) - clock.epoch_seconds(F.col("_start")) == span
        )
    return built.select(*keys, F.col("_target_time").alias(spec.time), "window", "y")


def _positions_by(df: DataFrame, spec: PanelSpec, parts: tuple[str, ...]) -> DataFrame:
    """Row positions inside each (series, parts) group."""
    if not parts:
        return blocks.with_positions(df, spec)
    packed = df.withColumn("_group", F.struct(spec.key, *parts)).drop(spec.key, *parts)
    placed = blocks.with_positions(packed, spec.but(key="_group"))
    return placed.select("_group.*", *[c for c in placed.columns if c != "_group"])


def flatten_windows(df: DataFrame, column: str = "window", out: str = "features") -> DataFrame:
    """A window of rows as one flat array, oldest row first."""
    return df.withColumn(out, F.flatten(column))


def latest_per_time(df: DataFrame, spec: PanelSpec, order: list[str]) -> DataFrame:
    """One row per series and time, the greatest by the ``order`` columns.

    An aggregate rather than a ranking, so many copies of one row are merged
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in (spec.key, spec.time)]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(spec.key, spec.time).agg(best).select(spec.key, spec.time, "_best.*")
