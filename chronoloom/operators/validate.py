"""Validation rules as data (C).

Each rule returns rows ``(series, rank, rule, detail)``.  ``rank`` keeps the
order in which rules apply, so the first failure of a series is the one with
the lowest rank.  :func:`enforce` raises on any failure; :func:`quarantine`
removes the failing series and lets the others go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import clock
from chronoloom.operators import blocks, combine, schema, windows
from chronoloom.spec import HorizonUnavailableError, PanelSpec, PanelValidationError

# Rules in the order they apply.
RULES = (
    "unreadable_time",
    "duplicate_time",
    "broken_cadence",
    "no_observed_row",
    "no_future_after_cutoff",
    "cutoff_not_in_data",
    "short_past",
    "unfilled_past",
    "no_future_rows",
    "bad_future_drivers",
    "short_future",
    "late_future",
)
SHOWN_TIMES = 3
SHOWN_DRIVER_TIMES = 5


def _failure(df: DataFrame, spec: PanelSpec, rule: str, detail: Column) -> DataFrame:
    return df.select(
        spec.key,
        F.lit(RULES.index(rule)).alias("rank"),
        F.lit(rule).alias("rule"),
        detail.cast("string").alias("detail"),
    )


def gather(failures: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, failures)


def first_failures(failures: DataFrame, spec: PanelSpec) -> DataFrame:
    """The failure that counts for each series."""
    return failures.groupBy(spec.key).agg(
        F.min_by("rule", "rank").alias("rule"), F.min_by("detail", "rank").alias("detail")
    )


def enforce(failures: DataFrame, spec: PanelSpec) -> None:
    """Raise for the first failing series by key; one row reaches the driver."""
    worst = first_failures(failures, spec).orderBy(spec.key).limit(1).collect()
    if worst:
        row = worst[0]
        raise PanelValidationError(f"{row[spec.key]}: {row['rule']}: {row['detail']}")


def quarantine(df: DataFrame, failures: DataFrame, spec: PanelSpec) -> DataFrame:
    return combine.without_series(df, failures, spec.key)


def unreadable_times(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Series without one readable timestamp."""
    none_read = df.groupBy(spec.key).agg(F.count(spec.time).alias("_n")).filter("_n = 0")
    return _failure(none_read, spec, "unreadable_time", F.lit("no timestamp could be read; use ISO 8601"))


def time_counts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Distinct times with their row counts; copies merge before the shuffle."""
    return df.groupBy(spec.key, spec.time).agg(F.count("*").alias("copies"))


def duplicate_times(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Number of repeated times per series and the first three of them."""
    repeated = counts.filter(F.col("copies") > 1)
    shown = windows.oldest_rows(repeated, spec, SHOWN_TIMES).groupBy(spec.key).agg(
        F.array_sort(F.collect_list(spec.time)).alias("examples")
    )
    return repeated.groupBy(spec.key).agg(F.count("*").alias("duplicates")).join(shown, spec.key)


def cadence_gaps(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    """First step per series that is not one clock tick."""
    steps = windows.time_steps(counts.select(spec.key, spec.time), spec)
    tick = spec.cadence_seconds / 3600.0
    bad = steps.filter(F.col("previous").isNotNull() & (F.col("step_hours") != tick))
    return bad.groupBy(spec.key).agg(
        F.min("previous").alias("gap_start"),
        F.min(spec.time).alias("gap_end"),
        F.min_by("step_hours", spec.time).alias("gap_hours"),
        F.count("*").alias("gaps"),
    )


def _complete(spec: PanelSpec) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in spec.measured])


def _bad_driver(spec: PanelSpec) -> Column:
    return reduce(Column.__or__, [unusable(c) for c in spec.drivers])


def _known_targets(spec: PanelSpec) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in spec.targets])


def block_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """What the rules need to know of each block of a series; merged on the map side, so few rows move.

    Sums of blocks answer for whole series.  Only the block in which a cutoff lies has to be read row by row.
    """
    complete = _complete(spec)
    return df.groupBy(spec.key, blocks.time_block(spec).alias(blocks.BLOCK)).agg(
        F.count("*").alias("_rows"),
        F.max(spec.time).alias("_last"),
        F.count_if(complete).alias("_full"),
        F.max(F.when(complete, F.col(spec.time))).alias("_last_full"),
        F.count_if(_bad_driver(spec)).alias("_bad"),
        F.count_if(_known_targets(spec)).alias("_known"),
        *[F.count(c).alias(f"_seen_{c}") for c in spec.measured],
    )


def detect_cutoff(df: DataFrame, spec: PanelSpec, summary: DataFrame | None = None) -> DataFrame:
    """Last fully observed row that is not the final row (C4).

    One row per series: ``cutoff_ts`` is NULL when there is none, ``observed``
    counts the fully observed rows.  ``summary`` is :func:`block_summary`, where it is at hand.
    """
    parts = block_summary(df, spec) if summary is None else summary
    whole = parts.groupBy(spec.key).agg(
        F.max("_last").alias("_end"),
        F.sum("_full").alias("observed"),
        F.max("_last_full").alias("_newest"),
        F.max(blocks.BLOCK).alias("_end_block"),
    )
    # Where the final row is full itself, the answer is the one before it: in its block, or else in an earlier one.
    closed = whole.filter(F.col("_newest") == F.col("_end")).select(spec.key, F.col("_end_block").alias(blocks.BLOCK), "_end")
    earlier = parts.join(closed.withColumnRenamed(blocks.BLOCK, "_end_block"), spec.key).filter(F.col(blocks.BLOCK) < F.col("_end_block"))
    earlier = earlier.groupBy(spec.key).agg(F.max("_last_full").alias("_earlier"))
    full = df.filter(_complete(spec)).select(spec.key, spec.time, blocks.time_block(spec).alias(blocks.BLOCK))
    inside = full.join(closed, [spec.key, blocks.BLOCK]).filter(F.col(spec.time) < F.col("_end"))
    inside = inside.groupBy(spec.key).agg(F.max(spec.time).alias("_inside"))
    cutoff = F.when(F.col("_newest") < F.col("_end"), F.col("_newest")).otherwise(F.coalesce("_inside", "_earlier"))
    return whole.join(earlier, spec.key, "left").join(inside, spec.key, "left").select(spec.key, cutoff.alias("cutoff_ts"), "observed")


def cutoff_failures(detected: DataFrame, spec: PanelSpec) -> DataFrame:
    none = detected.filter(F.col("cutoff_ts").isNull())
    return gather(
        [
            _failure(none.filter("observed = 0"), spec, "no_observed_row",
                     F.lit("no row has every target and driver")),
            _failure(none.filter("observed > 0"), spec, "no_future_after_cutoff",
                     F.lit("only the last row is fully observed; name a cutoff")),
        ]
    )


def explicit_cutoff(df: DataFrame, cutoffs: DataFrame, spec: PanelSpec) -> DataFrame:
    """Requested cutoffs with a flag telling whether that hour exists."""
    wanted = cutoffs.select(spec.key, F.col("cutoff_ts").alias(spec.time))
    times = df.select(spec.key, spec.time).join(wanted, [spec.key, spec.time], "left_semi").distinct()
    found = times.select(spec.key, F.col(spec.time).alias("cutoff_ts"), F.lit(True).alias("_found"))
    return cutoffs.select(spec.key, "cutoff_ts").join(
        found, [spec.key, "cutoff_ts"], "left"
    ).select(spec.key, "cutoff_ts", F.coalesce("_found", F.lit(False)).alias("in_data"))


def explicit_cutoff_failures(checked: DataFrame, spec: PanelSpec) -> DataFrame:
    return _failure(checked.filter(~F.col("in_data")), spec, "cutoff_not_in_data",
                    F.concat(clock.iso_utc(F.col("cutoff_ts")), F.lit(" is not a time of the series")))


def unusable(c: str) -> Column:
    """Missing, NaN or infinite."""
    value = F.col(c)
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def _edges(cutoffs: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each cutoff with the start of the future and the blocks of both."""
    start = clock.shift(F.col("cutoff_ts"), spec.cadence_seconds)
    size = spec.cadence_seconds * spec.block_rows
    return cutoffs.select(spec.key, "cutoff_ts", start.alias("_start")).withColumns(
        {"_cut_block": clock.ticks(F.col("cutoff_ts"), size), "_start_block": clock.ticks(F.col("_start"), size)}
    )


def _near(df: DataFrame, edges: DataFrame, spec: PanelSpec) -> DataFrame:
    """The rows in the blocks of the cutoff and of the start, a bounded number for each series."""
    both = F.explode(F.array_distinct(F.array("_cut_block", "_start_block")))
    near = edges.select(spec.key, "cutoff_ts", "_start", both.alias(blocks.BLOCK))
    return df.withColumn(blocks.BLOCK, blocks.time_block(spec)).join(near, [spec.key, blocks.BLOCK])


def cut_summary(df: DataFrame, cutoffs: DataFrame, spec: PanelSpec, summary: DataFrame | None = None) -> DataFrame:
    """Everything the later rules need to know about each side of the cutoff.

    Rows per side, known values per column before it, hours with unusable
    drivers after it, and whether every target after it is known.  Blocks on one side of the cutoff are added up from
    :func:`block_summary`; rows are read only in the blocks at the cutoff.
    """
    edges = _edges(cutoffs, spec)
    sums = block_summary(df, spec) if summary is None else summary
    whole = sums.join(edges, spec.key)
    before, after = F.col(blocks.BLOCK) < F.col("_cut_block"), F.col(blocks.BLOCK) > F.col("_start_block")
    past, future = F.col(spec.time) <= F.col("cutoff_ts"), F.col(spec.time) >= F.col("_start")
    rows = _near(df, edges, spec)
    seen = [f"_seen_{c}" for c in spec.measured]

    def each(a: Column, b: Column, counted: dict[str, Column]) -> list[Column]:
        return [F.when(a, counted["_rows"]).otherwise(0).alias("n_past"), *[
            F.when(b, counted[c]).otherwise(0).alias(n) for n, c in (("n_future", "_rows"), ("bad_future", "_bad"), ("_known", "_known"))
        ], *[F.when(a, counted[c]).otherwise(0).alias(c) for c in seen]]

    of_blocks = {c: F.col(c) for c in ("_rows", "_bad", "_known", *seen)}
    of_rows = {"_rows": F.lit(True), "_bad": _bad_driver(spec), "_known": _known_targets(spec)}
    of_rows |= {f"_seen_{c}": F.col(c).isNotNull() for c in spec.measured}
    of_rows = {c: v.cast("bigint") for c, v in of_rows.items()}
    parts = whole.filter(before | after).select(spec.key, "cutoff_ts", *each(before, after, of_blocks)).unionByName(
        rows.select(spec.key, "cutoff_ts", *each(past, future, of_rows))
    )
    numbers = [c for c in parts.columns if c not in (spec.key, "cutoff_ts")]
    out = parts.groupBy(spec.key, "cutoff_ts").agg(*[F.sum(c).alias(c) for c in numbers])
    whole_future = (F.col("_known") == F.col("n_future")) & (F.col("n_future") > 0)
    return out.withColumn("has_actuals", whole_future).drop("_known")


def bad_future_times(df: DataFrame, cutoffs: DataFrame, spec: PanelSpec) -> DataFrame:
    """Hours after the cutoff with unusable drivers: count and the first five."""
    edges = _edges(cutoffs, spec)
    bad = df.filter(_bad_driver(spec)).select(spec.key, spec.time)
    listed = [F.count("*").alias("_n"), F.slice(F.array_sort(F.collect_list(spec.time)), 1, SHOWN_DRIVER_TIMES).alias("_times")]
    # A block holds few times; blocks after the cutoff count as they are, those at it by their rows.
    by_block = bad.groupBy(spec.key, blocks.time_block(spec).alias(blocks.BLOCK)).agg(*listed)
    far = by_block.join(edges, spec.key).filter(F.col(blocks.BLOCK) > F.col("_start_block")).select(*by_block.columns)
    near = _near(bad, edges, spec).filter(F.col(spec.time) >= F.col("_start")).groupBy(spec.key, blocks.BLOCK).agg(*listed)
    parts = far.unionByName(near)
    rank = F.row_number().over(Window.partitionBy(spec.key).orderBy(blocks.BLOCK))
    first = parts.withColumn("_rank", rank).filter(F.col("_rank") <= SHOWN_DRIVER_TIMES)
    shown = first.groupBy(spec.key).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_times"))), 1, SHOWN_DRIVER_TIMES).alias("examples")
    )
    return parts.groupBy(spec.key).agg(F.sum("_n").alias("bad_hours")).join(shown, spec.key)


def past_failures(summary: DataFrame, spec: PanelSpec) -> DataFrame:
    """Too few past rows (C3), or a past column without any value."""
    empty = F.filter(
        F.array(*[F.when(F.col(f"_seen_{c}") == 0, F.lit(c)) for c in spec.measured]),
        lambda c: c.isNotNull(),
    )
    listed = summary.withColumn("_empty", empty)
    return gather(
        [
            _failure(summary.filter(F.col("n_past") < spec.window), spec, "short_past",
                     F.concat(F.col("n_past").cast("string"), F.lit(f" past rows, at least {spec.window} needed"))),
            _failure(listed.filter(F.size("_empty") > 0), spec, "unfilled_past",
                     F.concat(F.lit("no value to fill from in: "), F.array_join("_empty", ", "))),
        ]
    )


def future_failures(summary: DataFrame, bad: DataFrame, spec: PanelSpec) -> DataFrame:
    listed = F.array_join(F.transform("examples", lambda t: clock.iso_utc(t)), ", ")
    more = F.col("bad_hours") - F.size("examples")
    detail = F.concat(
        F.lit("drivers are not interpolated; unusable at "), listed,
        F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")),
    )
    return gather(
        [
            _failure(summary.filter("n_future = 0"), spec, "no_future_rows", F.lit("no rows after the cutoff")),
            _failure(bad, spec, "bad_future_drivers", detail),
        ]
    )


def available_horizons(n_future: Column, spec: PanelSpec) -> Column:
    """The offered horizons that the future rows cover."""
    return F.filter(F.array(*[F.lit(h) for h in spec.horizons]), lambda h: h <= n_future)


def check_horizon(header: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    """Header rows of the series that can be forecast this far."""
    if horizon not in spec.horizons:
        offered = ", ".join(str(h) for h in spec.horizons)
        raise HorizonUnavailableError(f"Horizon {horizon} is not offered; choose from {offered}.")
    return header.filter(F.col("n_future") >= horizon)


def require_horizon(header: DataFrame, spec: PanelSpec, horizon: int) -> None:
    """Raise when a series has too few future rows for the horizon."""
    check_horizon(header, spec, horizon)
    short = header.filter(F.col("n_future") < horizon).orderBy(spec.key).limit(1).collect()
    if short:
        row = short[0]
        raise HorizonUnavailableError(
            f"{row[spec.key]}: horizon {horizon} needs {horizon} future rows, {row['n_future']} available."
        )


def horizon_failures(header: DataFrame, spec: PanelSpec, horizon: int) -> DataFrame:
    """Accepted series with fewer future rows than the horizon needs."""
    check_horizon(header, spec, horizon)
    short = header.filter(F.col("n_future") < horizon)
    return _failure(short, spec, "short_future",
                    F.concat(F.col("n_future").cast("string"), F.lit(f" future rows, {horizon} needed")))


def late_failures(late: DataFrame, spec: PanelSpec) -> DataFrame:
    return _failure(late, spec, "late_future",
                    F.concat(F.lit("the future begins at "), clock.iso_utc(F.col("first_future"))))


def starts_after_cutoff(future: DataFrame, header: DataFrame, spec: PanelSpec) -> DataFrame:
    """Series whose future does not begin one tick after the cutoff."""
    first = future.groupBy(spec.key).agg(F.min(spec.time).alias("first_future"))
    due = clock.shift(F.col("cutoff_ts"), spec.cadence_seconds)
    return header.join(first, spec.key).filter(F.col("first_future") != due).select(
        spec.key, "cutoff_ts", "first_future"
    )


def non_finite(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Rows per key with a missing or non-finite number in ``cols`` (C11)."""
    bad = reduce(Column.__or__, [unusable(c) for c in cols])
    return df.filter(bad).groupBy(key).agg(F.count("*").alias("bad_rows"))


def enough_rows(df: DataFrame, spec: PanelSpec, minimum: int) -> DataFrame:
    """Row count per series and whether it reaches the minimum."""
    return df.groupBy(spec.key).agg(F.count("*").alias("rows")).withColumn(
        "enough", F.col("rows") >= minimum
    )


def months_present(df: DataFrame, spec: PanelSpec, year: int, history: int, target: int) -> DataFrame:
    """Rows in the history month of ``year`` and in the target month after it, and whether a backtest can run (C14)."""
    return df.groupBy(spec.key).agg(
        F.count_if(schema.in_month(spec, year, history)).alias("history_rows"),
        F.count_if(schema.in_month(spec, schema.year_of_target(year, history, target), target)).alias("target_rows"),
    ).withColumn("usable", (F.col("history_rows") >= spec.window) & (F.col("target_rows") > 0))


def duplicate_failures(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    dup = duplicate_times(counts, spec)
    listed = F.array_join(F.transform("examples", lambda t: clock.iso_utc(t)), ", ")
    return _failure(dup, spec, "duplicate_time", F.concat(F.lit("repeated times: "), listed))


def cadence_failures(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    gaps = cadence_gaps(counts, spec)
    detail = F.concat(
        clock.iso_utc(F.col("gap_start")), F.lit(" -> "), clock.iso_utc(F.col("gap_end")),
        F.lit(" is a step of "), F.col("gap_hours").cast("string"), F.lit(" h"),
    )
    return _failure(gaps, spec, "broken_cadence", detail)
