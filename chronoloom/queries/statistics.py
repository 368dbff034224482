"""Exploratory statistics and scaling over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import gram, scale, stats, windows
from chronoloom.queries import panels as P
from chronoloom.queries import sql as S
from chronoloom.queries.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(select: str, name: str, source: str = "lineitem") -> str:
    """One SELECT per column, ``{c}`` standing for the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, {select.replace('{c}', c)} FROM {source}" for c in NUMBERS
    )


@query(
    _per_column(
        ", ".join(
            [S.r("avg({c})", "mean"), S.r("quantile_cont({c}, 0.5)", "median"), S.r("min({c})", "min"),
             S.r("max({c})", "max"), S.r("stddev_samp({c})", "std")]
        ),
        "pollutant",
    )
)
def stat_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.statistical_summary(P.lineitem_numbers(spark, sf), NUMBERS)
    return P.settled(out, ["mean", "median", "min", "max", "std"])


@query(
    f"""WITH {S.STATION_PANEL} """
    + " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_count FROM panel GROUP BY 1"
        for c in S.MEASURED
    )
)
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.missing_report(P.station_panel(spark, sf), S.MEASURED, ("series_id",))


def _iqr_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
      {S.r('100.0 * count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(v)', 'outlier_pct')}
      FROM (SELECT {c} AS v FROM panel), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM panel)"""


@query(f"WITH {S.STATION_PANEL} " + " UNION ALL ".join(_iqr_sql(c) for c in S.TARGETS))
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.iqr_outliers(P.station_panel(spark, sf), S.TARGETS), ["outlier_pct"])


DESCRIBED = ", ".join(
    ["count({c}) AS count"]
    + [S.r(e, n) for n, e in {
        "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "p25": "quantile_cont({c}, 0.25)",
        "p50": "quantile_cont({c}, 0.5)", "p75": "quantile_cont({c}, 0.75)", "max": "max({c})"}.items()]
)
DESCRIBE_COLS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


@query(_per_column(DESCRIBED, '"column"'))
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.describe(P.lineitem_numbers(spark, sf), NUMBERS), DESCRIBE_COLS)


@query(
    f"WITH {S.USER_PANEL} SELECT series_id, 'y' AS \"column\", {DESCRIBED.replace('{c}', 'y')} FROM panel GROUP BY 1"
)
def describe_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.describe(P.user_hours(spark, sf), ["y"], ("series_id",)), DESCRIBE_COLS)


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {S.r(f'corr({a}, {b})', 'corr', 6)} FROM lineitem"
        for a in NUMBERS for b in NUMBERS
    )
)
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.correlations(P.lineitem_numbers(spark, sf), NUMBERS), ["corr"], 6)


def _histogram_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", bins, bin, {S.r('lo + (bin - 1) * ((hi - lo) / bins)', 'bin_start')},
      {S.r('lo + bin * ((hi - lo) / bins)', 'bin_end')}, count(*) AS count
      FROM (SELECT lo, hi, bins, CASE WHEN hi = lo THEN 1
              ELSE least(CAST(floor(({c} - lo) / ((hi - lo) / bins)) AS INTEGER) + 1, bins) END AS bin
            FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi,
              CAST(least(60, greatest(10, floor(sqrt(count({c}))))) AS INTEGER) AS bins FROM lineitem)
            WHERE {c} IS NOT NULL) GROUP BY bins, bin, lo, hi"""


@query(" UNION ALL ".join(_histogram_sql(c) for c in NUMBERS))
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.settled(stats.histogram(P.lineitem_numbers(spark, sf), NUMBERS), ["bin_start", "bin_end"])


@query(
    """SELECT count(*) AS rows, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_day,
    3 AS numeric_columns FROM events"""
)
def overview(spark: SparkSession, sf: str) -> DataFrame:
    named = P.table(spark, sf, "events").withColumnRenamed("ts", "timestamp").withColumn("lat", F.lit(0.0))
    out = stats.overview(named)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def _train_sql() -> str:
    return f"""{S.STATION_PANEL}, kept AS (SELECT * FROM panel WHERE {S.ALL_KNOWN}),
    placed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 <
      floor(0.8 * count(*) OVER (PARTITION BY series_id)) THEN 'train' ELSE 'test' END AS split FROM kept)"""


def split_panel(spark: SparkSession, sf: str) -> DataFrame:
    kept = P.station_panel(spark, sf).na.drop("any")
    return windows.split_fraction(kept, P.WIDE)


ZSCORED = ", ".join(
    S.r(f"({c} - m_{c}) / CASE WHEN s_{c} < 1e-8 THEN 1.0 ELSE s_{c} END", c, 6) for c in S.MEASURED
)
ZSTATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in S.MEASURED)


@query(
    f"""WITH {_train_sql()}, st AS (SELECT series_id AS k, {ZSTATS} FROM placed WHERE split = 'train' GROUP BY 1)
    SELECT series_id, time, split, {ZSCORED} FROM placed JOIN st ON st.k = series_id"""
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Per series, fitted on its training rows."""
    panel = split_panel(spark, sf)
    fitted = scale.fit_zscore(panel.filter("split = 'train'"), S.MEASURED, ("series_id",))
    out = scale.apply_zscore(panel, fitted, S.MEASURED, ("series_id",))
    return P.settled(out, S.MEASURED, 6)


@query(
    f"""WITH {_train_sql()}, st AS (SELECT {ZSTATS} FROM placed)
    SELECT series_id, time, split, {ZSCORED} FROM placed, st"""
)
def zscore_all(spark: SparkSession, sf: str) -> DataFrame:
    """One scaler for all series, fitted on all rows."""
    panel = split_panel(spark, sf)
    out = scale.apply_zscore(panel, scale.fit_zscore(panel, S.MEASURED), S.MEASURED)
    return P.settled(out, S.MEASURED, 6)


MINMAXED = ", ".join(
    S.r(f"({c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END", c, 6) for c in S.MEASURED
)
MMSTATS = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in S.MEASURED)


@query(
    f"""WITH {_train_sql()}, st AS (SELECT series_id AS k, {MMSTATS} FROM placed WHERE split = 'train' GROUP BY 1)
    SELECT series_id, time, split, {MINMAXED} FROM placed JOIN st ON st.k = series_id"""
)
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    panel = split_panel(spark, sf)
    fitted = scale.fit_minmax(panel.filter("split = 'train'"), S.MEASURED, ("series_id",))
    out = scale.apply_minmax(panel, fitted, S.MEASURED, ("series_id",))
    return P.settled(out, S.MEASURED, 6)


@query(f"WITH {_train_sql()} SELECT series_id, time, split, {S.rs(S.MEASURED)} FROM placed")
def inverse_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled and scaled back: the original values."""
    panel = split_panel(spark, sf)
    fitted = scale.fit_zscore(panel.filter("split = 'train'"), S.MEASURED, ("series_id",))
    scaled = scale.apply_zscore(panel, fitted, S.MEASURED, ("series_id",))
    back = scale.invert_zscore(scaled, fitted, {c: c for c in S.MEASURED}, ("series_id",))
    return P.settled(back, S.MEASURED)


COMPONENTS = [f"e{i}" for i in range(64)]


@query(
    f"""WITH cells AS (SELECT vec_id, label, 'e' || (i - 1) AS c, CASE WHEN abs(embedding[i]) >= 0.01 THEN CAST(embedding[i] AS DOUBLE) END AS x
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
    SELECT a.label, a.c AS column_a, b.c AS column_b, {S.r('corr(a.x, b.x)', 'corr', 5)}
    FROM cells a JOIN cells b ON a.vec_id = b.vec_id GROUP BY ALL"""
)
def corr_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations among all components of the embeddings by label, small ones counting as missing."""
    vectors = P.table(spark, sf, "embeddings")
    cells = [F.when(F.abs(F.col("embedding")[i]) >= 0.01, F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate(COMPONENTS)]
    return P.settled(gram.correlations_wide(vectors.select("label", *cells), COMPONENTS, ("label",)), ["corr"], 5)
