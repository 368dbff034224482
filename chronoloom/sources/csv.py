"""CSV panels and uploads (A1-A4)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import coerce
from chronoloom.session import durable
from chronoloom.spec import PanelSpec


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; types are given later, never guessed from the data."""
    try:
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"There is no dataset at {path}") from exc
        raise


def read_panel_csv(spark: SparkSession, path: str, spec: PanelSpec, series: str | None = None) -> DataFrame:
    """A CSV with typed time and measured columns; ``series`` names the series of a file without a key."""
    raw = read_text_csv(spark, path)
    if spec.key not in raw.columns:
        # A plain constant would turn every join of the series into a product of all rows.
        named = F.when(F.length("_metadata.file_path") >= 0, F.lit(series or "series"))
        raw = raw.select("*", named.alias(spec.key))
    timed = coerce.parse_time_lenient(raw, spec)
    return coerce.numeric(timed, spec.measured)


def _series_of(path: Column, folder: str) -> Column:
    """Place of a file inside the folder without its ending; the URL form of a path is undone."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    inside = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/")
    # From the first place where the folder's own path stands; a folder given as a pattern leaves the file's name.
    found = F.regexp_extract(plain, f"^.*?{re.escape(inside)}/(.+?)(?:\\.[^./]*)?$", 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(plain, r"([^/]+?)(?:\.[^./]*)?$", 1))


def _cells(line: Column, n: int) -> Column:
    """The n cells of a CSV line, NULL where it has fewer; a quote inside quotes is doubled."""
    names = [f"c{i}" for i in range(n)]
    parsed = F.from_csv(line, ", ".join(f"{c} string" for c in names), {"escape": '"'})
    return F.array(*[parsed[c] for c in names])


def read_uploads(spark: SparkSession, folder: str, spec: PanelSpec) -> DataFrame:
    """Every CSV under a folder as one text frame; a file's place in the folder is its series.

    All files are read in one scan, whatever their names.  Each line is split by its own file's header, so columns may
    stand in any order, be missing or be extra; names are matched without regard to case and outer blanks, and of a
    name that a file has twice the first counts.  A record is one line.  The driver learns which column names there
    are, nothing about single files.  ``row_order`` orders the rows of one file as they stand in it, also when a large
    file is read in several splits.  Files without a line under
    their header give no row.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_path"), place.alias("row_order"))
    # The first line of a file is the first one of its first split.
    opening = F.when(F.col("row_order.offset") == 0, F.struct("row_order", "value"))
    heads = lines.groupBy("_path").agg(F.min(opening).alias("_h"))
    heads = durable(heads.select("_path", F.col("_h.row_order").alias("_first"), F.ltrim(F.col("_h.value"), F.lit("\ufeff")).alias("_head")))
    commas = F.length("_head") - F.length(F.replace("_head", F.lit(",")))
    width = (heads.agg(F.max(commas)).first()[0] or 0) + 1
    named = F.transform(_cells(F.col("_head"), width), lambda c, i: F.coalesce(F.trim(c), F.concat(F.lit("_c"), i.cast("string"))))
    heads = heads.select("_path", "_first", named.alias("_names"), F.transform(named, F.lower).alias("_keys"), (commas + 1).alias("_n"))
    pairs = heads.select(F.explode(F.slice(F.arrays_zip(F.col("_keys").alias("k"), F.col("_names").alias("name"), F.sequence(F.lit(1), F.lit(width)).alias("i")), 1, F.col("_n"))).alias("p"))
    # A name that files spell in different ways is given in lower case.
    spelled = F.when(F.min("p.name") == F.max("p.name"), F.min("p.name")).otherwise(F.col("k"))
    columns = pairs.groupBy("p.k").agg(F.min("p.i").alias("at"), spelled.alias("name")).orderBy("at", "k").collect()
    rows = lines.join(heads, "_path").filter((F.col("row_order") != F.col("_first")) & (F.trim("value") != ""))
    cells = rows.withColumn("_cells", _cells(F.col("value"), width))
    # Cells past a header's own names belong to no column.
    found = [F.get("_cells", F.array_position(F.slice("_keys", 1, F.col("_n")), F.lit(c.k)).cast("int") - 1).alias(c.name) for c in columns]
    return cells.select(*found, _series_of(F.col("_path"), folder).alias(spec.key), "row_order")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part per partition, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
