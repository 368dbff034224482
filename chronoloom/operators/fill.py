"""Gap filling and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.operators import blocks
from chronoloom.operators.blocks import BLOCK
from chronoloom.spec import PanelSpec


def _known(at: str, column: str) -> Column:
    return F.when(
        F.col(column).isNotNull(), F.struct(F.col(at).alias("at"), F.col(column).alias("v"))
    )


def with_neighbours(df: DataFrame, spec: PanelSpec, cols: list[str], at: str) -> DataFrame:
    """Add ``_prev_<c>`` and ``_next_<c>``: the nearest known (at, value) on each side.

    A row whose value is known is its own neighbour.  Edges of a block are
    bridged by the first and last known value of every block of the series.
    """
    keyed = blocks.by_block(df, spec)

    edges = []
    for c in cols:
        when_known = F.when(F.col(c).isNotNull(), F.col(at))
        edges += [
            F.min(when_known).alias(f"_fa_{c}"),
            F.min_by(c, when_known).alias(f"_fv_{c}"),
            F.max(when_known).alias(f"_la_{c}"),
            F.max_by(c, when_known).alias(f"_lv_{c}"),
        ]
    summary = keyed.select(spec.key, BLOCK, at, *cols).groupBy(spec.key, BLOCK).agg(*edges)
    asc = Window.partitionBy(spec.key).orderBy(F.col(BLOCK).asc()).rowsBetween(Window.unboundedPreceding, -1)
    desc = Window.partitionBy(spec.key).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def edge(kind: str, c: str) -> Column:
        at_col, v_col = F.col(f"_{kind}a_{c}"), F.col(f"_{kind}v_{c}")
        return F.when(at_col.isNotNull(), F.struct(at_col.alias("at"), v_col.alias("v")))

    carried = summary.select(
        spec.key,
        BLOCK,
        *[F.last(edge("l", c), ignorenulls=True).over(asc).alias(f"_cp_{c}") for c in cols],
        *[F.last(edge("f", c), ignorenulls=True).over(desc).alias(f"_cn_{c}") for c in cols],
    )

    # Both directions in one order, so that a block is sorted once.
    order = blocks.in_block(spec)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = keyed.withColumns({f"_own_{c}": _known(at, c) for c in cols}).withColumns(
        {
            **{f"_prev_{c}": F.last(f"_own_{c}", ignorenulls=True).over(upto) for c in cols},
            **{f"_next_{c}": F.expr(f"lead(`_own_{c}`) IGNORE NULLS").over(order) for c in cols},
        }
    )
    bridged = inside.join(carried, [spec.key, BLOCK]).withColumns(
        {
            **{f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_cp_{c}") for c in cols},
            **{f"_next_{c}": F.coalesce(f"_own_{c}", f"_next_{c}", f"_cn_{c}") for c in cols},
        }
    )
    return bridged.drop(BLOCK, *[f"_{kind}_{c}" for kind in ("cp", "cn", "own") for c in cols])


def _line(prev: Column, nxt: Column, at: Column) -> Column:
    share = (at - prev["at"]) / (nxt["at"] - prev["at"])
    return prev["v"] + (nxt["v"] - prev["v"]) * share


def _fill_between(
    df: DataFrame,
    spec: PanelSpec,
    cols: list[str] | tuple[str, ...],
    at: str,
    inner: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """Fill NULLs: ``inner`` between two known values, the nearest known value at the ends."""
    cols = list(cols)
    wide = with_neighbours(df, spec, cols, at)
    here = F.col(at)

    def filled(c: str) -> Column:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        return (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNull(), nxt["v"])
            .when(nxt.isNull(), prev["v"])
            .otherwise(inner(prev, nxt, here))
        )

    return wide.withColumns({c: filled(c) for c in cols}).select(*[c for c in df.columns if c != BLOCK])


def _with_seconds(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn("_at", clock.epoch_seconds(F.col(spec.time)))


def fill_limited(df: DataFrame, spec: PanelSpec, cols, limit: int | None = None) -> DataFrame:
    """Two-sided limited fill on a regular clock.

    Within ``limit`` ticks of a known value on either side the straight line in
    time is used.  Deeper inside a long gap the value reached ``limit`` ticks
    after the left neighbour stays.  Only a column with no known value at all
    keeps NULLs.
    """
    reach = (spec.gap_limit if limit is None else limit) * spec.cadence_seconds

    def inner(prev: Column, nxt: Column, at: Column) -> Column:
        near = ((at - prev["at"]) <= reach) | ((nxt["at"] - at) <= reach)
        return F.when(near, _line(prev, nxt, at)).otherwise(_line(prev, nxt, prev["at"] + reach))

    return _fill_between(_with_seconds(df, spec), spec, cols, "_at", inner).drop("_at")


def fill_time(df: DataFrame, spec: PanelSpec, cols) -> DataFrame:
    """Straight line in time between known values, nearest value at the ends."""
    return _fill_between(_with_seconds(df, spec), spec, cols, "_at", _line).drop("_at")


def fill_linear(df: DataFrame, spec: PanelSpec, cols) -> DataFrame:
    """Straight line in row position, nearest value at the ends."""
    placed = blocks.with_positions(df, spec, keep_block=True)
    return _fill_between(placed, spec, cols, blocks.POSITION, _line).select(*df.columns)


def fill_carry(df: DataFrame, spec: PanelSpec, cols) -> DataFrame:
    """Last known value forward, then first known value backward."""
    return _fill_between(
        _with_seconds(df, spec), spec, cols, "_at", lambda prev, nxt, at: prev["v"]
    ).drop("_at")


def resample_daily(df: DataFrame, spec: PanelSpec, cols) -> DataFrame:
    """Daily means ignoring NULLs; a day without rows is present with NULLs."""
    day = spec.daily()
    means = (
        df.withColumn(spec.time, clock.floor_to(F.col(spec.time), day.cadence_seconds))
        .groupBy(spec.key, spec.time)
        .agg(*[F.avg(c).alias(c) for c in cols])
    )
    bounds = means.groupBy(spec.key).agg(
        F.min(spec.time).alias("_first"), F.max(spec.time).alias("_last")
    )
    days = blocks.spine(bounds, day, "_first", "_last")
    return days.join(means, [spec.key, spec.time], "left").select(spec.key, spec.time, *cols)
