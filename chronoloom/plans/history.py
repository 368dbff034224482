"""Queries over run history and settings tables (L, I2, I3, G5, B18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import labels
from chronoloom.plans import recursive
from chronoloom.spec import PanelSpec

ALL_MODELS = "All"
SETTING_COLUMNS = ("user_id", "default_model", "updated_at")


def newest_order(runs: DataFrame) -> list[Column]:
    """Insertion order, newest first; ``batch_row`` orders the rows of one append."""
    return [F.col(c).desc() for c in ("inserted_seq", "batch_row") if c in runs.columns]


def recent_runs(runs: DataFrame, limit: int = 50, user_id: int | None = None) -> DataFrame:
    """Newest runs by insertion, of one user or of each user.

    For all users the rank filter cuts each user to ``limit`` rows before the
    shuffle.
    """
    if user_id is not None:
        shown = runs.filter(F.col("user_id") == user_id).orderBy(*newest_order(runs)).limit(limit)
    else:
        newest = Window.partitionBy("user_id").orderBy(*newest_order(runs))
        shown = runs.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= limit).drop("_rank")
    # Only runs that are shown have their JSON read.
    return shown.withColumn("results", labels.readable_json(F.col("results")))


def day_of_run() -> Column:
    """The date of a run's timestamp; NULL where it has none."""
    return F.substring("timestamp", 1, 10).try_cast("date")


def filtered_runs(
    runs: DataFrame,
    user_id: int | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    model_used: str | None = None,
) -> DataFrame:
    """Runs in an inclusive date range and of one model; a filter left out does not apply (L2)."""
    day = day_of_run()
    out = runs
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if start_date:
        out = out.filter(day >= F.lit(start_date).cast("date"))
    if end_date:
        out = out.filter(day <= F.lit(end_date).cast("date"))
    if model_used and model_used != ALL_MODELS:
        out = out.filter(F.col("model_used") == model_used)
    return out


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(*newest_order(runs))


def run_list(runs: DataFrame) -> DataFrame:
    """Run id, displayed date and model of each run (B18); :func:`by_date` orders them to show."""
    date = F.substring(F.coalesce(F.nullif("upload_date", F.lit("")), F.col("timestamp")), 1, 16)
    return runs.select("run_id", "user_id", date.alias("date"), F.col("model_used").alias("model"))


def by_date(listed: DataFrame) -> DataFrame:
    """A run list by displayed date, newest first."""
    return listed.orderBy(F.col("date").desc(), "run_id")


def without_deleted(runs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Runs without a tombstone of the same user and run (L3).

    The user is held by bounds, not by an equality, so that runs are shuffled by ``run_id`` alone, as their rows are.
    """
    gone = tombstones.select(F.col("user_id").alias("_user"), F.col("run_id").alias("_run"))
    same = (F.col("run_id") == F.col("_run")) & F.col("user_id").between(F.col("_user"), F.col("_user"))
    return runs.join(gone, same, "left_anti").select("user_id", "run_id", *[c for c in runs.columns if c not in ("user_id", "run_id")])


def without_users(runs: DataFrame, deleted_users: DataFrame) -> DataFrame:
    """Runs of users that still exist."""
    return runs.join(deleted_users.select("user_id"), "user_id", "left_anti")


def normalised_settings(settings: DataFrame) -> DataFrame:
    return settings.withColumn("default_model", labels.model_label(F.col("default_model")))


def latest_settings(settings: DataFrame) -> DataFrame:
    """One row per user, the last write winning (L4).

    ``inserted_seq`` and ``batch_row`` tell which of two writes of one moment came last; the label decides only where a
    table has no arrival order at all.
    """
    arrival = [c for c in ("inserted_seq", "batch_row") if c in settings.columns]
    value = F.max_by("default_model", F.struct("updated_at", *arrival, "default_model"))
    return settings.groupBy("user_id").agg(
        value.alias("default_model"), F.max("updated_at").alias("updated_at")
    )


def upsert_settings(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Current settings with the changes applied, labels normalised (L4)."""
    return latest_settings(current.unionByName(normalised_settings(changes), allowMissingColumns=True))


def settings_of(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Each user with the stored model label, or the default one."""
    return users.join(settings.select("user_id", "default_model"), "user_id", "left").withColumn(
        "default_model", labels.stored_label(F.col("default_model"))
    )


def migrated_settings(legacy: DataFrame) -> DataFrame:
    """Known columns only, old labels rewritten."""
    return legacy.select(*SETTING_COLUMNS).withColumn(
        "default_model", labels.stored_label(F.col("default_model"))
    )


def dataset_rows(runs: DataFrame, spec: PanelSpec) -> DataFrame:
    """Past rows rebuilt from payloads, of runs that stored no file (A5)."""
    return recursive.payload_rows(_without_file(runs, "dataset_csv"), spec, "history", ("run_id",))


def prediction_rows(runs: DataFrame, spec: PanelSpec) -> DataFrame:
    """Forecast rows rebuilt from payloads, of runs that stored no file (A5)."""
    return recursive.payload_rows(_without_file(runs, "prediction_csv"), spec, "forecast", ("run_id",))


def _without_file(runs: DataFrame, column: str) -> DataFrame:
    return runs.filter(F.coalesce(F.octet_length(column), F.lit(0)) == 0)


def stored_files(runs: DataFrame, column: str) -> DataFrame:
    """Stored file content as text, of runs that have it (A5)."""
    kept = runs.filter(F.coalesce(F.octet_length(column), F.lit(0)) > 0)
    return kept.select("run_id", F.decode(column, "UTF-8").alias("content"))


# Which payload part stands for which stored file.
FILES = {"history": "dataset_csv", "forecast": "prediction_csv"}


def run_files(runs: DataFrame, spec: PanelSpec, part: str) -> DataFrame:
    """The CSV text of each run: the file as stored, or else rebuilt from the payload's ``part`` (A5).

    ``stored`` tells which.  A run without either has no row; a payload part is as short as a forecast, so a run's lines
    are put together in one row.
    """
    kept = stored_files(runs, FILES[part]).withColumn("stored", F.lit(True))
    rows = dataset_rows(runs, spec) if part == "history" else prediction_rows(runs, spec)
    columns = [c for c in rows.columns if c != "run_id"]
    lines = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("time", F.to_csv(F.struct(*columns)).alias("line")))).alias("_l"))
    text = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.col("_l.line"), "\n"), F.lit("\n"))
    return kept.unionByName(lines.select("run_id", text.alias("content"), F.lit(False).alias("stored")))
