"""What the operators share: reading tables, settings of Arrow batches, words and their hashes in numpy."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
#: Texts are hashed together up to so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, np.int8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts make batches of Spark's default row count too large for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 texts; null is empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES."""
    begin = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > CHUNK_BYTES:
            yield begin, i
            begin, total = i, 0
        total += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        n = max(n, CHUNK_BYTES * 2)
        out = np.full(n, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > CHUNK_BYTES * 2:
            return out
        _powers[base] = out
    return _powers[base]


_sums: list[np.ndarray] = [np.zeros(1, np.uint64)]


def _power_sums(n: int) -> np.ndarray:
    """Sums of the first 0, 1, ... powers, n + 1 of them at least."""
    if len(_sums[0]) <= n:
        powers = _power(_BASE, n)
        out = np.zeros(len(powers) + 1, np.uint64)
        np.cumsum(powers, out=out[1:])
        if n > CHUNK_BYTES * 2:
            return out
        _sums[0] = out
    return _sums[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more at the end).

    Words are maximal runs without the six ASCII white-space characters; ``lower`` lower-cases A-Z.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = LOWER[buf]
    edge = np.diff(SPACE[buf], prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begins = np.cumsum([0] + [len(x) + 1 for x in texts])
    return span_hashes(running_hash(buf), start, end), np.searchsorted(start, begins)


def running_hash(buf: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of bytes follows."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * _power(_BASE, len(buf))[: len(buf)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal bytes wherever they stand.

    Each byte counts one more than its value, so that 0 counts: a span adds the powers of its places.
    """
    ones = _power_sums(len(total) - 1)
    return mix((total[end] - total[start] + ones[end] - ones[start]) * _power(_INVERSE, len(total) - 1)[start])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + h[j : j + m]
    return mix(out)
