"""Boosted trees with the pseudo-Huber loss, and the best round by validation loss.

A round grows one regression tree per target on the Newton step of every row, weighted by curvature, on a sample of rows
and columns.  All targets grow together, one job a level: tasks add gradients and curvatures of their rows by node, column
and bin, Spark adds these sums over tasks, and each block of columns names its best split, so only splits reach the driver.
Bins are cut once, at quantiles of all training rows, and a row's bins lie packed next to its targets.  What a leaf adds is
the regularised Newton step of its rows, which the sums of its last split give.  Margins are written out every few rounds;
between, tasks apply the few trees since then.  A target is done when its validation loss has not fallen for ``patience``
rounds, and keeps the trees up to its best round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import metrics, scale
from chronoloom.plans.training import TrainingFrames
from chronoloom.session import durable
from chronoloom.spec import PanelSpec

LOSSES_SCHEMA = "target string, round int, train_loss double, valid_loss double"


@dataclass(frozen=True)
class BoostSettings:
    # Rounds, depth, step, shares, seed and leaf penalty of the models to match.
    rounds: int = 200
    depth: int = 6
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    penalty: float = 1.0
    slope: float = 1.0
    max_bins: int = 32
    #: Rounds without a smaller validation loss after which a target is done; None runs all rounds.
    patience: int | None = 5
    stored_every: int = 10


#: Samples a task should have at least, and how many are counted at a time.
TASK_ROWS, CHUNK_ROWS = 4000, 1000
#: Columns whose sums one group adds up.
COLUMN_BLOCK = 128
SUMS_SCHEMA = "target int, node int, block int, sums binary"
SPLITS_SCHEMA = "target int, node int, column int, bin int, gain double, lg double, lh double, rg double, rh double"


@dataclass
class Tree:
    """Nodes in level order; an inner node sends a row left where the column's value is at most the threshold."""

    column: list[int]
    bin: list[int]
    threshold: list[float]
    left: list[int]
    #: The number of a leaf, -1 for an inner node.
    leaf: list[int]
    #: What each leaf adds to the margin.
    values: list[float]

    @classmethod
    def root(cls) -> Tree:
        return cls([-1], [0], [0.0], [-1], [0], [])

    def split(self, node: int, column: int, cut: int, threshold: float) -> int:
        """Give a node two children; returns the left one, the right one follows it."""
        at = len(self.column)
        self.column[node], self.bin[node], self.threshold[node], self.left[node] = column, cut, threshold, at
        self.column += [-1, -1]
        self.bin += [0, 0]
        self.threshold += [0.0, 0.0]
        self.left += [-1, -1]
        return at

    def number_leaves(self) -> None:
        ends = iter(range(len(self.left)))
        self.leaf = [next(ends) if x < 0 else -1 for x in self.left]

    def reached(self, cells: np.ndarray, binned: bool) -> np.ndarray:
        """The node each row ends in, by bins or by values."""
        limit, column, left = np.array(self.bin if binned else self.threshold), np.array(self.column), np.array(self.left)
        at = np.zeros(len(cells), np.int64)
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            n = at[rows]
            at[rows] = left[n] + (cells[rows, column[n]] > limit[n])
            rows = rows[left[at[rows]] >= 0]
        return at

    def added(self, frame: DataFrame, leaf: str) -> DataFrame:
        """``frame`` with the number of the leaf each row falls into."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = _matrix(batch.column(batch.num_columns - 1))
                found = pa.array(np.array(self.leaf)[self.reached(cells, False)].astype(float))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], leaf])

        return _on_values(frame, run, f"{leaf} double")

    def step(self, cells: np.ndarray, binned: bool) -> np.ndarray:
        """What the tree adds to the margin of each row."""
        return np.array([0.0, *self.values])[np.array(self.leaf)[self.reached(cells, binned)] + 1]


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _on_values(frame: DataFrame, run, more: str) -> DataFrame:
    """``frame`` past ``run``, which sees the feature values as a last column and puts ``more`` in its place."""
    # Arrow batches hold no vectors, so these travel as arrays.
    shown = frame.withColumns({"features": vector_to_array("features"), "_cells": vector_to_array("features")})
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1])
    out = shown.mapInArrow(run, f"{plain}, {more}")
    return out.withColumn("features", array_to_vector("features"))


@dataclass
class BoostedTrees:
    """Trees of all targets; ``losses`` has a row per target and round, round 0 being the start."""

    start: list[float]
    trees: list[list[Tree]]
    best: list[int]
    losses: DataFrame
    #: Per target and round: sums of gradients and curvatures and the value of each leaf.
    leaves: list[tuple[str, int, int, float, float, float]] = field(repr=False)

    def margins(self, samples: DataFrame) -> DataFrame:
        """``samples`` with ``margin``, the prediction of every target in scaled units."""
        used = [t[:b] for t, b in zip(self.trees, self.best)]
        start = self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = _matrix(batch.column(batch.num_columns - 1))
                margin = np.tile(np.array(start), (batch.num_rows, 1))
                for i, trees in enumerate(used):
                    for tree in trees:
                        margin[:, i] += tree.step(cells, False)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(margin)], names=[*batch.schema.names[:-1], "margin"])

        return _on_values(samples, run, "margin array<double>")


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def loss(z: Column, slope: float) -> Column:
    return (F.sqrt(1 + F.pow(z / slope, F.lit(2.0))) - 1) * (slope * slope)


def gradient(z: Column, slope: float) -> Column:
    return z / F.sqrt(1 + F.pow(z / slope, F.lit(2.0)))


def curvature(z: Column, slope: float) -> Column:
    return F.pow(1 + F.pow(z / slope, F.lit(2.0)), F.lit(-1.5))


def _sampled(spec: PanelSpec, r: int, target: int, settings: BoostSettings) -> Column:
    """Whether a row takes part in a tree; the same row does on every run."""
    draw = F.pmod(F.xxhash64(spec.key, spec.time, F.lit(settings.seed), F.lit(r), F.lit(target)), F.lit(1 << 20))
    return (F.col("split") == "train") & (draw < int(settings.row_share * (1 << 20)))


def _shown_columns(width: int, r: int, target: int, settings: BoostSettings) -> np.ndarray:
    """Whether a tree may split on a column."""
    rng = np.random.default_rng([settings.seed, r, target])
    shown = np.zeros(width, bool)
    shown[rng.choice(width, max(1, int(settings.column_share * width)), replace=False)] = True
    return shown


def _edges(samples: DataFrame, settings: BoostSettings) -> list[np.ndarray]:
    """Per column the upper ends of all bins but the last, from quantiles of all training rows."""
    shares = [k / settings.max_bins for k in range(1, settings.max_bins)]
    cells = samples.filter("split = 'train'").select(F.posexplode(vector_to_array("features")).alias("column", "value"))
    found = cells.groupBy("column").agg(F.percentile_approx("value", shares, 10_000).alias("edges"))
    by_column = {row["column"]: np.unique(row["edges"]) for row in found.collect()}
    return [by_column[c] for c in range(len(by_column))]


def _binned(samples: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``samples`` with the bins of all columns as bytes in place of the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _matrix(batch.column(batch.num_columns - 1))
            bins = np.stack([np.searchsorted(e, cells[:, c]) for c, e in enumerate(edges)], 1).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "bins"])

    shown = samples.withColumn("features", vector_to_array("features"))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.drop("features").schema.fields)
    return shown.select(*shown.drop("features").columns, "features").mapInArrow(run, f"{plain}, bins binary")


def _unpacked(batch: pa.RecordBatch, trees: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a batch, and its margins after ``trees``, which the stored ones lack."""
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    margin = _matrix(batch["margin"]).copy()
    for i, more in enumerate(trees):
        for tree in more:
            margin[:, i] += tree.step(bins, True)
    return bins, margin


def _advanced(frame: DataFrame, trees: list[list[Tree]]) -> DataFrame:
    """Margins after more trees of each target."""
    at = frame.columns.index("margin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = _lists(_unpacked(batch, trees)[1])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


def _best_splits(
    frame: DataFrame, spec: PanelSpec, r: int, pending: list[list[Tree]], growing: dict[int, Tree], open_: dict[int, list[int]], width: int, settings: BoostSettings
) -> dict[tuple[int, int], dict]:
    """The best split of every open node of the trees that grow, by target and node."""
    bins_of = settings.max_bins
    slope = settings.slope

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(low, CHUNK_ROWS)
                bins, margin = _unpacked(batch, pending)
                y, used = _matrix(batch["y"]), _matrix(batch["used"])
                cells = bins + np.arange(width) * bins_of
                for k, (i, tree) in enumerate(growing.items()):
                    place = np.full(len(tree.left), -1)
                    place[open_[i]] = np.arange(len(open_[i]))
                    at = place[tree.reached(bins, True)]
                    mine = np.flatnonzero(used[:, k] & (at >= 0))
                    z = margin[mine, i] - y[mine, i]
                    into = (cells[mine] + at[mine, None] * (width * bins_of)).ravel()
                    size = len(open_[i]) * width * bins_of
                    root = np.sqrt(1 + (z / slope) ** 2)
                    one = [np.bincount(into, np.repeat(w, width), size) for w in (z / root, root**-3)]
                    sums[i] = sums[i] + np.stack(one) if i in sums else np.stack(one)
        for i, both in sums.items():
            both = both.reshape(2, len(open_[i]), width, bins_of)
            for n, node in enumerate(open_[i]):
                if both[1, n, 0].any():
                    parts = [both[:, n, c : c + COLUMN_BLOCK] for c in range(0, width, COLUMN_BLOCK)]
                    packed = pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())
                    m = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * m, pa.int32()), pa.array([node] * m, pa.int32()), pa.array(range(m), pa.int32()), packed],
                        names=["target", "node", "block", "sums"],
                    )

    shown = {i: _shown_columns(width, r, i, settings) for i in growing}

    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, node, block = (k.as_py() for k in key)
        total = sum(np.frombuffer(x, float) for batch in batches for x in batch["sums"].to_pylist())
        g, h = np.asarray(total).reshape(2, -1, bins_of)
        lg, lh = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
        ag, ah = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
        rg, rh = ag - lg, ah - lh
        # Where the bins beyond a cut are empty, differences of sums leave a rest.
        filled = (h != 0)[:, ::-1].cumsum(1)[:, ::-1][:, 1:] > 0
        fits = (lh > 0) & (rh > 0) & filled & shown[target][block * COLUMN_BLOCK :][: len(g), None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, lg**2 / lh + rg**2 / rh - ag**2 / ah, -np.inf)
        c, cut = np.unravel_index(gain.argmax(), gain.shape)
        found = [target, node, block * COLUMN_BLOCK + int(c), int(cut), gain[c, cut], lg[c, cut], lh[c, cut], rg[c, cut], rh[c, cut]]
        types = [pa.int32()] * 4 + [pa.float64()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(found, types)], names=["target", "node", "column", "bin", "gain", "lg", "lh", "rg", "rh"]
        )

    used = F.array(*[_sampled(spec, r, i, settings) for i in growing]).alias("used")
    rows = frame.filter("split = 'train'").select("bins", "y", "margin", used)
    told = rows.mapInArrow(count, SUMS_SCHEMA).groupBy("target", "node", "block").applyInArrow(choose, SPLITS_SCHEMA).collect()
    best: dict[tuple[int, int], dict] = {}
    for row in sorted(told, key=lambda x: (-x["gain"], x["column"])):
        best.setdefault((row["target"], row["node"]), row.asDict())
    return best


def _grown(
    frame: DataFrame, spec: PanelSpec, r: int, pending: list[list[Tree]], targets: list[int], edges: list[np.ndarray], settings: BoostSettings
) -> tuple[dict[int, Tree], dict[int, dict[int, tuple[float, float]]]]:
    """A tree of each target, and the sums of gradients and curvatures by leaf."""
    growing = {i: Tree.root() for i in targets}
    # Sums of the root come with its split, those of other nodes with the split above.
    sums: dict[int, dict[int, tuple[float, float]]] = {i: {} for i in targets}
    open_ = {i: [0] for i in targets}
    for _ in range(settings.depth):
        asked = {i: t for i, t in growing.items() if open_[i]}
        if not asked:
            break
        best = _best_splits(frame, spec, r, pending, asked, open_, len(edges), settings)
        for i, tree in asked.items():
            below = []
            for node in open_[i]:
                x = best.get((i, node))
                if x is None:
                    continue
                sums[i].setdefault(node, (x["lg"] + x["rg"], x["lh"] + x["rh"]))
                if x["gain"] > 0:
                    left = tree.split(node, x["column"], x["bin"], float(edges[x["column"]][x["bin"]]))
                    sums[i] |= {left: (x["lg"], x["lh"]), left + 1: (x["rg"], x["rh"])}
                    below += [left, left + 1]
            open_[i] = below
    for i, tree in growing.items():
        tree.number_leaves()
        sums[i] = {tree.leaf[node]: x for node, x in sums[i].items() if tree.leaf[node] >= 0}
        tree.values = [0.0] * (len(tree.left) // 2 + 1)
        for leaf, (g, h) in sums[i].items():
            tree.values[leaf] = -settings.step * g / (h + settings.penalty)
    return growing, sums


def _losses(frame: DataFrame, pending: list[list[Tree]], n: int, settings: BoostSettings) -> tuple[list[float | None], list[float | None]]:
    """Mean loss of every target on training and on validation rows."""
    moved = _advanced(frame, pending) if any(pending) else frame
    terms = [loss(F.col("margin")[i] - F.col("y")[i], settings.slope) for i in range(n)]
    means = [F.avg(F.when(F.col("split") == part, t)).alias(f"{part}{i}") for part in ("train", "valid") for i, t in enumerate(terms)]
    row = moved.agg(*means).first()
    return [row[f"train{i}"] for i in range(n)], [row[f"valid{i}"] for i in range(n)]


def _start(samples: DataFrame, n: int, settings: BoostSettings) -> list[float]:
    """The Newton step of all training rows from 0, where every target starts."""
    z = [-F.col("y")[i] for i in range(n)]
    sums = [-F.sum(gradient(x, settings.slope)) / F.sum(curvature(x, settings.slope)) for x in z]
    row = samples.filter("split = 'train'").agg(*sums).first()
    return [row[i] or 0.0 for i in range(n)]


def train_boosted(frames: TrainingFrames, spec: PanelSpec, settings: BoostSettings = BoostSettings()) -> BoostedTrees:
    """Trees for all targets; without validation rows all rounds are run and kept."""
    spark = frames.samples.sparkSession
    n = len(spec.targets)
    samples = frames.samples.filter("split IN ('train', 'valid')")
    start = _start(samples, n, settings)
    edges = _edges(samples, settings)
    margin = F.array(*map(F.lit, start)).alias("margin")
    # Many passes follow, so rows are dealt evenly first, over as many tasks as they can keep busy.
    rows = samples.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS))
    frame = _binned(samples.select(spec.key, spec.time, "split", "features", "y", margin), edges)
    frame = durable(frame.repartition(parts, spec.key, spec.time))
    pending: list[list[Tree]] = [[] for _ in range(n)]
    train, valid = _losses(frame, pending, n, settings)
    told = [(spec.targets[i], 0, train[i], valid[i]) for i in range(n)]
    trees: list[list[Tree]] = [[] for _ in range(n)]
    least, best = list(valid), [0] * n
    leaves = []
    going = list(range(n))
    for r in range(settings.rounds):
        grown, sums = _grown(frame, spec, r, pending, going, edges, settings)
        for i, tree in grown.items():
            leaves += [(spec.targets[i], r + 1, leaf, g, h, tree.values[leaf]) for leaf, (g, h) in sums[i].items()]
            trees[i].append(tree)
            pending[i].append(tree)
        if r % settings.stored_every == settings.stored_every - 1:
            frame, pending = durable(_advanced(frame, pending)), [[] for _ in range(n)]
        train, valid = _losses(frame, pending, n, settings)
        for i in list(going):
            told.append((spec.targets[i], r + 1, train[i], valid[i]))
            if valid[i] is None or least[i] is None or valid[i] < least[i]:
                least[i], best[i] = valid[i], r + 1
            elif settings.patience is not None and r + 1 - best[i] >= settings.patience:
                going.remove(i)
        if not going:
            break
    return BoostedTrees(start, trees, best, spark.createDataFrame(told, LOSSES_SCHEMA), leaves)


def chosen_rounds(losses: DataFrame) -> DataFrame:
    """Per target the round with the smallest validation loss, the first on a tie."""
    return metrics.best_candidate(losses, "round", "valid_loss", ("target",))


def predict_boosted(frames: TrainingFrames, model: BoostedTrees, spec: PanelSpec, split: str = "test") -> DataFrame:
    """One-step predictions in original units: ``<target>_pred`` and ``<target>_actual`` (K4)."""
    scored = model.margins(frames.samples.filter(F.col("split") == split))
    columns = {f"{t}_pred": F.col("margin")[i] for i, t in enumerate(spec.targets)}
    columns |= {f"{t}_actual": F.col("y")[i] for i, t in enumerate(spec.targets)}
    raw = scored.withColumns(columns).select(spec.key, spec.time, *columns)
    return scale.invert_zscore(raw, frames.stats, {c: c.rsplit("_", 1)[0] for c in columns})
