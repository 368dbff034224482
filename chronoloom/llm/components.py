"""Connected components of a link table by joins: everyone learns the smallest id that neighbours know, then jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import discard, durable

MAX_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    """Count and checksums of distinct edges: equal exactly when nothing has moved, but for a chance of 2**-128."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ends of links (a, b); a component is named by its smallest id.

    Each round hangs the larger end of every link, and the roots it knows, under the smaller root, as in the
    alternating large-star and small-star scheme; the number of rounds grows with the logarithm of a component.
    Only ids travel, pre-aggregated by minimum, so a hub with many links is no single group of rows.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        # Large star: larger neighbours of u go under the smallest neighbour of u.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u != v").distinct())
        # Small star: u and its smaller neighbours go under the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        small = durable(small.where("u != v").distinct())
        discard(edges, large)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    named = durable(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots))
    discard(edges)
    return named
