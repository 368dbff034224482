"""Huber regression on windows that are never stored.

A window of 48 rows repeats every row 48 times.  Here the rows themselves are stored once, in blocks with a halo of one
window, and a task builds the windows of one block at a time as views of it.  What training needs are sums over
windows: once the matrix of lagged cross products, and in each step the products of the windows with the clipped
residuals.  Tasks add up their own sums, Spark adds those by row of the matrix, and the driver solves one system of the
size of a window.  The objective is that of :func:`training.train_linear` without penalty, its scale estimated along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import calendar
from chronoloom.operators import blocks, scale, windows
from chronoloom.operators.blocks import BLOCK, POSITION
from chronoloom.plans import recursive, training
from chronoloom.session import durable
from chronoloom.spec import PanelSpec

#: Relative change of the weights below which training ends.
TOLERANCE = 1e-7


@dataclass(frozen=True)
class LaggedRows:
    """``rows``: key, split, time, block, position, own, ``x`` and ``y``, sorted inside blocks; ``stats``: the scaler."""

    rows: DataFrame
    stats: DataFrame


def lagged_rows(panel: DataFrame, spec: PanelSpec, fraction: float | None = training.TRAIN_FRACTION) -> LaggedRows:
    """Calendar features, chronological split and scaling as :func:`training.training_frames`, each row stored once."""
    labelled = calendar.with_calendar(training.usable_rows(panel, spec), spec)
    if fraction is None:
        labelled = labelled.withColumn("split", F.lit("train"))
    else:
        labelled = windows.split_fraction(labelled, spec, fraction)
    labelled = durable(labelled)
    stats = durable(scale.fit_zscore(labelled.filter("split = 'train'"), spec.features))
    scaled = scale.apply_zscore(labelled, stats, spec.features)
    return LaggedRows(durable(blocked(scaled, spec, ("split",))), stats)


def blocked(df: DataFrame, spec: PanelSpec, parts: tuple[str, ...] = ()) -> DataFrame:
    """Rows in blocks by position, each block with the rows of one window before it."""
    frame = df.select(spec.key, *parts, spec.time, F.array(*spec.features).alias("x"), F.array(*spec.targets).alias("y"))
    placed = windows._positions_by(frame, spec, parts).drop(blocks.LENGTH)
    return blocks.with_halo(placed, F.col(POSITION), max(spec.block_rows, spec.window), before=spec.window)


def _dealt(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    group = [spec.key, "split", BLOCK]
    ordered = rows.select(F.xxhash64(*group).alias("group"), *group, POSITION, "_own", spec.time, "x", "y")
    return ordered.repartition(*group).sortWithinPartitions(*group, POSITION).select("group", spec.key, "split", spec.time, "_own", "x", "y")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after the other; a block may lie on several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
        for low, high in zip(edges[:-1], edges[1:]):
            if held and held[0].column("group")[0].as_py() != group[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _windows(table: pa.Table, spec: PanelSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the block's own rows that have a whole window before them, their windows after a 1, and their targets."""
    x, y = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1) for c in ("x", "y"))
    own = np.flatnonzero(table.column("_own").to_numpy())
    own = own[own >= spec.window]
    if not len(own):
        return own, np.zeros((0, 1 + spec.window * x.shape[1])), y[:0]
    views = np.lib.stride_tricks.sliding_window_view(x, spec.window, axis=0).transpose(0, 2, 1)
    flat = views[own - spec.window].reshape(len(own), -1)
    return own, np.hstack([np.ones((len(own), 1)), flat]), y[own]


def _summed(rows: DataFrame, spec: PanelSpec, sums, height: int, width: int) -> np.ndarray:
    """``sums(windows, targets)`` added over all blocks, a matrix whose rows travel one by one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for table in _groups(batches):
            _, z, y = _windows(table, spec)
            if len(z):
                total += sums(z, y)
        lines = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))
        yield pa.record_batch([pa.array(np.arange(height, dtype=np.int32)), lines], names=["i", "line"])

    def added(table: pa.Table) -> pa.Table:
        line = np.stack(table.column("line").to_pylist()).sum(0)
        return pa.table({"i": table.column("i").slice(0, 1), "line": pa.array([line.tolist()])})

    schema = "i int, line array<double>"
    lines = _dealt(rows.filter("split = 'train'"), spec).mapInArrow(partial, schema).groupBy("i").applyInArrow(added, schema)
    out = np.zeros((height, width))
    for row in lines.collect():
        out[row.i] = row.line
    return out


def cross_products(data: LaggedRows, spec: PanelSpec) -> np.ndarray:
    """Sums over training windows of all products of (1, window, targets): lagged cross products in one matrix."""
    n = 1 + spec.window * len(spec.features) + len(spec.targets)

    def sums(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.hstack([z, y])
        return both.T @ both

    return _summed(data.rows, spec, sums, n, n)


def train_huber(
    data: LaggedRows, spec: PanelSpec, settings: training.LinearSettings = training.LinearSettings()
) -> recursive.LinearModel:
    """Huber weights of every target: residuals are clipped and the least squares step repeated until nothing moves.

    A step with clipped residuals never raises the objective, and needs one vector per target instead of a matrix.
    """
    width, n_targets, eps = 1 + spec.window * len(spec.features), len(spec.targets), settings.epsilon
    products = cross_products(data, spec)
    n = products[0, 0]
    solve = np.linalg.pinv(products[:width, :width], hermitian=True)
    beta = solve @ products[:width, width:]
    squares = np.diag(products)[width:] - (beta * products[:width, width:]).sum(0)
    sigma = np.sqrt(np.maximum(squares / n, 1e-12))
    for _ in range(settings.iterations):

        def sums(z: np.ndarray, y: np.ndarray, beta: np.ndarray = beta, sigma: np.ndarray = sigma) -> np.ndarray:
            r = y - z @ beta
            inside = np.abs(r) < eps * sigma
            clipped = np.where(inside, r, np.sign(r) * eps * sigma)
            return np.vstack([z.T @ clipped, (r * r * inside).sum(0), (~inside).sum(0)])

        out = _summed(data.rows, spec, sums, width + 2, n_targets)
        step = solve @ out[:width]
        beta = beta + step
        # Where the objective is flat in the scale: inner squares against what outer rows count.
        sigma = np.sqrt(np.maximum(out[width] / np.maximum(n - eps * eps * out[width + 1], 1e-12), 1e-12))
        if np.abs(step).max() <= TOLERANCE * max(np.abs(beta).max(), 1e-12):
            break
    return recursive.LinearModel(
        rows=spec.window, weights=tuple(tuple(map(float, beta[1:, i])) for i in range(n_targets)), intercepts=tuple(map(float, beta[0]))
    )


def predict_lagged(data: LaggedRows, model: recursive.LinearModel, spec: PanelSpec, split: str = "test") -> DataFrame:
    """One-step predictions in original units: ``<target>_pred`` and ``<target>_actual`` (K4)."""
    beta = np.vstack([model.intercepts, np.array(model.weights).T])
    columns = [f"{t}_{side}" for side in ("pred", "actual") for t in spec.targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            own, z, y = _windows(table, spec)
            values = np.hstack([z @ beta, y])
            keys = [table.column(c).take(pa.array(own)).combine_chunks() for c in (spec.key, spec.time)]
            yield pa.record_batch([*keys, *(pa.array(v) for v in values.T)], names=[spec.key, spec.time, *columns])

    kinds = ", ".join(f"`{c}` {data.rows.schema[c].dataType.simpleString()}" for c in (spec.key, spec.time))
    scored = _dealt(data.rows.filter(F.col("split") == split), spec).mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in columns))
    return scale.invert_zscore(scored, data.stats, {c: c.rsplit("_", 1)[0] for c in columns})
