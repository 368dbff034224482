"""Turning untrusted text into numbers and timestamps, bad values into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.spec import PanelSpec, PanelValidationError

# Fixed patterns: which texts count as a number or as a timestamp.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
DAY = r"(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4})"
CLOCK = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})"
TIMESTAMP = f"^{DAY}({CLOCK}{OFFSET}?)?$"


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """A double, or NULL where the value is not a number; NaN is NULL too."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        value = c.cast("double")
    else:
        text = c.cast("string")
        value = F.when(
            text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast("double")
        )
    return F.when(~F.isnan(value), value)


def numeric(df: DataFrame, cols: list[str] | tuple[str, ...]) -> DataFrame:
    """Coerce the listed columns that exist; others stay as they are."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in cols if c in types})


def layout_of(text: Column) -> Column:
    """The shape a timestamp is written in, such as ``Y-d-d d:d:d``; NULL when unreadable."""
    trimmed = F.trim(text)
    shape = F.regexp_replace(F.regexp_replace(trimmed, r"\d{4}", "Y"), r"\d+", "d")
    return F.when(trimmed.rlike(TIMESTAMP), shape)


def parse_utc(text: Column) -> Column:
    """Any supported layout to UTC wall-clock time; NULL when unreadable."""
    trimmed = F.trim(text)
    dashed = F.regexp_replace(trimmed, r"^(\d{4})/(\d{1,2})/", "$1-$2-")
    dashed = F.regexp_replace(dashed, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    iso = F.when(trimmed.contains("/"), dashed).otherwise(trimmed)
    offset = F.regexp_extract(iso, r":\d{2}(?:\.\d+)?" + OFFSET + "$", 1)
    naive = F.substring(iso, F.lit(1), F.length(iso) - F.length(offset))
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    signed = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    wall = F.when(trimmed.rlike(TIMESTAMP), naive.try_cast("timestamp_ntz"))
    return F.when(F.length(digits) == 4, F.timestamp_add("MINUTE", -signed, wall)).otherwise(wall)


def _as_utc(c: Column, dtype: T.DataType) -> Column:
    """Typed timestamps and dates to UTC wall-clock time."""
    if isinstance(dtype, T.TimestampType):
        local = c.cast("timestamp_ntz")
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)
    return c.cast("timestamp_ntz")


def parse_time_lenient(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each row may use its own layout; unreadable values become NULL."""
    dtype = df.schema[spec.time].dataType
    if isinstance(dtype, T.StringType):
        return df.withColumn(spec.time, parse_utc(F.col(spec.time)))
    return df.withColumn(spec.time, _as_utc(F.col(spec.time), dtype))


def parse_time_strict(df: DataFrame, spec: PanelSpec, order: str | None = None) -> DataFrame:
    """The first value of a series fixes its layout; values in another layout become NULL.

    Where the first value cannot be read there is no layout, and each value is read on its own.

    ``order`` names the column that tells which row came first.  Without it the
    layout most rows of the series use is taken, the first by name on a tie.
    """
    dtype = df.schema[spec.time].dataType
    if not isinstance(dtype, T.StringType):
        return df.withColumn(spec.time, _as_utc(F.col(spec.time), dtype))
    marked = df.withColumn("_layout", layout_of(F.col(spec.time)))
    present = marked.filter(F.col(spec.time).isNotNull())
    if order is not None:
        chosen = present.groupBy(spec.key).agg(F.min_by("_layout", order).alias("_chosen"))
    else:
        chosen = (
            present.filter(F.col("_layout").isNotNull())
            .groupBy(spec.key, "_layout")
            .agg(F.count("*").alias("_n"))
            .groupBy(spec.key)
            .agg(F.min_by("_layout", F.struct(-F.col("_n"), F.col("_layout"))).alias("_chosen"))
        )
    return (
        marked.join(chosen, spec.key, "left")
        .withColumn(
            spec.time,
            F.when(
                F.col("_chosen").isNull() | (F.col("_layout") == F.col("_chosen")), parse_utc(F.col(spec.time))
            ),
        )
        .drop("_layout", "_chosen")
    )


def drop_unreadable_times(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.filter(F.col(spec.time).isNotNull())


def require_time_column(df: DataFrame, spec: PanelSpec) -> None:
    if spec.time not in df.columns:
        raise PanelValidationError(f"The input has no '{spec.time}' column.")
