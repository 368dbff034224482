"""Column shaping: names, dropped columns, fixed schemas, alignment (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import coerce
from chronoloom.spec import GEO_NAMES, PanelSpec, PanelValidationError


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case column names; two columns that become equal are refused."""
    names = [c.strip().lower() for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise PanelValidationError(f"Columns differ only in case or spaces: {', '.join(clashes)}")
    return df.toDF(*names)


def drop_named(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Drop columns whose trimmed, lower-cased name is listed."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.strip().lower() not in names])


def drop_geo(df: DataFrame) -> DataFrame:
    return drop_named(df, GEO_NAMES)


def drop_metadata(df: DataFrame) -> DataFrame:
    return drop_named(df, (*GEO_NAMES, "city"))


def require_columns(df: DataFrame, required: tuple[str, ...], where: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise PanelValidationError(f"Missing {where} column(s): {', '.join(missing)}.")


def expected_schema(
    df: DataFrame, spec: PanelSpec, source: str = "uploaded", also: tuple[str, ...] = ()
) -> DataFrame:
    """Exactly time, the targets, ``city`` and ``source`` behind the series key.

    A missing target is 0.0, a missing time NULL, a missing city ``unknown``;
    other columns are dropped but for those listed in ``also``.  The series key
    is the city when there is none.
    """
    named = normalise_names(df)
    have = set(named.columns)

    def pick(name: str, otherwise) -> F.Column:
        return (F.col(name) if name in have else otherwise).alias(name)

    city = pick("city", F.lit("unknown"))
    key = F.col(spec.key) if spec.key in have else (F.col("city") if "city" in have else F.lit("unknown"))
    return named.select(
        key.alias(spec.key),
        pick(spec.time, F.lit(None).cast("timestamp_ntz")),
        *[pick(c, F.lit(0.0)) for c in spec.targets],
        city,
        F.lit(source).alias("source"),
        *also,
    )


def numeric_columns(df: DataFrame, besides: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in besides
    ]


def keep_numeric(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keys, *numeric_columns(df, keys))


def align(df: DataFrame, columns: list[str] | tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Keys, then the listed columns in order; an absent column is 0.0."""
    have = set(df.columns)
    return df.select(*keys, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])


def reindex(df: DataFrame, columns: list[str] | tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """Keys, then the listed columns in order; an absent column is NULL."""
    have = set(df.columns)
    return df.select(
        *keys, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns]
    )


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def suffixed(df: DataFrame, columns: list[str] | tuple[str, ...], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def in_month(spec: PanelSpec, year: int, month: int) -> Column:
    """Whether a row lies in one calendar month; a range of times, so that a scan can skip files."""
    after = (year + month // 12, month % 12 + 1)
    first, end = (F.lit(f"{y:04d}-{m:02d}-01").cast("timestamp_ntz") for y, m in ((year, month), after))
    return (F.col(spec.time) >= first) & (F.col(spec.time) < end)


def year_of_target(year: int, history_month: int, target_month: int) -> int:
    """The target month is the next one of its name after the history month."""
    return year if target_month > history_month else year + 1


def calendar_month(df: DataFrame, spec: PanelSpec, year: int, month: int) -> DataFrame:
    """Rows of one calendar month of one year."""
    return df.filter(in_month(spec, year, month))


def numeric_frame(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Key, time and the measured columns as numbers; a missing column is an error."""
    require_columns(df, spec.required_past, "input")
    return coerce.numeric(df, spec.measured).select(spec.key, spec.time, *spec.measured)
