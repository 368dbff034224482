"""Correlations among very many columns (E6): masked cross products by matrix instead of one expression per pair.

For each pair the rows where both are known count.  With values set to 0 where they are missing, all sums that such a
correlation needs are products of three matrices (values, squares, known flags), which numpy makes batch by batch.  A
task adds up its own products and hands on one row per column and key; Spark adds those rows.  Values are first moved
by the column's mean, which changes no correlation and keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.stats import known

#: Keys whose products a task holds at one time take up to so many numbers; then it hands them on and starts anew.
HELD = 1 << 24
#: A variance below this part of the mean square is rounding: the column is constant on the pair's rows.
ROUNDING = 1e-13
SUMS = ("n", "x", "xx", "xy")


def _products(x: np.ndarray) -> np.ndarray:
    """Sum x column x column: rows both know, values and squares of the first, products."""
    m = (~np.isnan(x)).astype(np.float64)
    v = np.nan_to_num(x)
    return np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])


def correlations_wide(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairwise-complete correlation matrix in long form, as :func:`stats.correlations` gives it.

    Meant for hundreds of columns; NaN is missing, and a pair of which one is constant has NULL.
    """
    width = len(columns)
    values = [known(F.col(c)) for c in columns]
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(width)]
    moved = F.array(*[v - F.lit(m) for v, m in zip(values, means)])
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("key"), moved.alias("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            # One column's sums of one key are a row, so no record grows with the square of the columns.
            for k, sums in held.items():
                parts = [pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), width).cast(pa.list_(pa.float64())) for s in sums]
                yield pa.record_batch([pa.array([k] * width), pa.array(np.arange(width, dtype=np.int32)), *parts], names=["key", "i", *SUMS])
            held.clear()

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            for c, k in enumerate(names.dictionary.to_pylist()):
                sums = _products(x[code == c])
                held[k] = held[k] + sums if k in held else sums
                if len(held) * 4 * width * width > HELD:
                    yield from handed_on()
        yield from handed_on()

    def added(table: pa.Table) -> pa.Table:
        sums = [np.stack(table.column(s).to_pylist()).sum(0) for s in SUMS]
        head = [pa.array([table.column("key")[0].as_py()]), pa.array([table.column("i")[0].as_py()], pa.int32())]
        return pa.table([*head, *(pa.array([s.tolist()]) for s in sums)], names=["key", "i", *SUMS])

    schema = "key string, i int, " + ", ".join(f"{s} array<double>" for s in SUMS)
    lines = rows.mapInArrow(partial, schema).groupBy("key", "i").applyInArrow(added, schema)
    # A pair needs the sums of both its columns over the rows both know: those of the other one stand in its own line.
    cells = lines.select("key", "i", F.posexplode(F.arrays_zip(*SUMS)).alias("j", "s"))
    mine = cells.select("key", "i", "j", "s.*")
    other = cells.select("key", F.col("j").alias("i"), F.col("i").cast("int").alias("j"), F.col("s.x").alias("y"), F.col("s.xx").alias("yy"))
    both = mine.join(other, ["key", "i", "j"])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = (F.col(sq) / n - F.pow(F.col(s) / n, F.lit(2.0)) for s, sq in (("x", "xx"), ("y", "yy")))
    varies = (vx > ROUNDING * F.col("xx") / n) & (vy > ROUNDING * F.col("yy") / n)
    corr = F.when(varies, (F.col("xy") / n - F.col("x") / n * (F.col("y") / n)) / F.sqrt(vx * vy))
    names = F.array(*map(F.lit, columns))
    named = [F.get(names, F.col(c)).alias(f"column_{a}") for a, c in (("a", "i"), ("b", "j"))]
    fields = [f for f in df.schema.fields if f.name in keys]
    parsed = F.from_json("key", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)) if keys else None
    kept = [parsed[k].alias(k) for k in keys]
    return both.select(*kept, *named, corr.alias("corr"))
