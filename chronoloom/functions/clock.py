"""Clock arithmetic on ``timestamp_ntz`` columns, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch() -> Column:
    return F.expr(EPOCH)


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970, rounded down also before 1970.

    Built from date and clock parts: a difference of timestamps would pass
    through the session zone and be an hour off around its clock changes.
    """
    day = F.unix_date(F.to_date(time)).cast("bigint")
    return day * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def epoch_micros(time: Column) -> Column:
    fraction = (F.extract(F.lit("SECOND"), time) - F.second(time)) * 1_000_000
    return epoch_seconds(time) * 1_000_000 + fraction.cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, epoch())


def ticks(time: Column, seconds: int) -> Column:
    """Number of whole ``seconds``-long steps since 1970."""
    return floor_div(epoch_seconds(time), seconds)


def floor_div(number: Column, size: int) -> Column:
    """Whole-number quotient rounded down, without passing through doubles."""
    return ((number - F.pmod(number, F.lit(size))) / F.lit(size)).cast("bigint")


def floor_to(time: Column, seconds: int) -> Column:
    return from_epoch_seconds(ticks(time, seconds) * F.lit(seconds))


def shift(time: Column, seconds: int | Column) -> Column:
    amount = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", amount, time)


def hours_between(start: Column, end: Column) -> Column:
    """Length of a span in hours, fractions kept."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(3_600_000_000.0)


def iso_utc(time: Column) -> Column:
    """ISO-8601 text with an explicit zero offset, fractions only when present."""
    text = F.translate(time.cast("string"), " ", "T")
    full = F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(full, F.lit("+00:00"))
