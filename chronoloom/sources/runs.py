"""Forecast runs as two tables, a header for each run and its forecast rows, joined by ``run_id`` (A6-A8, L, G5).

Both are appended in one commit of :class:`Versions`.  Rows of either table lie in a folder for the month of their run,
sorted by a bucket of the user: a range of dates lists only its months, and one user's rows are found by the files'
statistics.  Deletes append to a table of what is gone; they and
:meth:`RunStore.compact`, which rewrites what is left, make a new version and leave older ones as they are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.plans import history
from chronoloom.sources.history import now
from chronoloom.sources.versions import Versions
from chronoloom.spec import PanelSpec, PanelValidationError

BUCKETS = 64
#: Forecast rows of one place that a task rewrites, about.
PLACE_ROWS = 4_000_000
HEADER_SCHEMA = (
    "run_id string, user_id bigint, timestamp string, model_used string, forecast_horizon int, dataset_name string, "
    "upload_date string, avg_aqi double, risk_level string, details string, inserted_seq bigint, batch_row bigint"
)
PLACE_SCHEMA = "month string, user_bucket int"
PLACE = ("month", "user_bucket")
LAID_OUT = {"partition_by": PLACE[:1], "cluster_by": PLACE[1:]}
GONE_SCHEMA = "user_id bigint, run_id string"
GONE_USER_SCHEMA = "user_id bigint, before_seq bigint"
SETTING_SCHEMA = "user_id bigint, default_model string, updated_at timestamp_ntz, inserted_seq bigint, batch_row bigint"


def bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("bigint")), F.lit(BUCKETS)).cast("int")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def row_schema(spec: PanelSpec) -> str:
    """Columns of a forecast row: what was predicted, the drivers used, the band, and what was observed, if known."""
    values = [f"{t}_pred" for t in spec.targets] + [f"{d}_used" for d in spec.drivers]
    tail = [f"{t}_actual" for t in spec.targets]
    columns = ["run_id string", "user_id bigint", f"{spec.time} timestamp_ntz", *(f"{c} double" for c in values), "pm25_safety_level string"]
    return ", ".join(columns + [f"{c} double" for c in tail])


def _stamp() -> int:
    return int(dt.datetime.now(dt.timezone.utc).timestamp() * 1_000_000)


class RunView:
    """The store as it is in one version, whatever is written later."""

    def __init__(self, versions: Versions, spec: PanelSpec, version: int):
        self.versions, self.spec, self.version = versions, spec, version

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.versions.read(name, schema, self.version)

    def _placed(
        self, name: str, schema: str, user_id: int | None, start_date: str | None, end_date: str | None
    ) -> DataFrame:
        rows = self._read(name, f"{schema}, {PLACE_SCHEMA}")
        if user_id is not None:
            rows = rows.filter((F.col("user_bucket") == bucket(F.lit(user_id))) & (F.col("user_id") == user_id))
        if start_date:
            rows = rows.filter(F.col("month") >= month_of(F.lit(start_date).cast("date")))
        if end_date:
            rows = rows.filter(F.col("month") <= month_of(F.lit(end_date).cast("date")))
        return rows.drop(*PLACE)

    def runs(self, user_id: int | None = None, start_date: str | None = None, end_date: str | None = None, model_used: str | None = None) -> DataFrame:
        """Headers of runs that were not deleted, in an inclusive range of dates."""
        found = self._placed("runs", HEADER_SCHEMA, user_id, start_date, end_date)
        found = history.filtered_runs(found, user_id, start_date, end_date, model_used)
        # Without deletions there is nothing to meet, and runs stay where they were read.
        tables = self.versions.manifest(self.version)
        if tables.get("gone_users"):
            users = self._read("gone_users", GONE_USER_SCHEMA).groupBy("user_id").agg(F.max("before_seq").alias("before_seq"))
            kept = found.join(users, "user_id", "left").filter("before_seq IS NULL OR inserted_seq > before_seq")
            found = kept.select(*found.columns)
        # Last by run, which is how runs meet their rows next.
        if tables.get("gone"):
            found = history.without_deleted(found, self._read("gone", GONE_SCHEMA))
        return found.select("user_id", "run_id", *[c for c in found.columns if c not in ("user_id", "run_id")])

    def forecast_rows(self, user_id: int | None = None, start_date: str | None = None, end_date: str | None = None, model_used: str | None = None) -> DataFrame:
        """Forecast rows of the same runs, with the model that made them and the horizon."""
        rows = self._placed("forecast_rows", row_schema(self.spec), user_id, start_date, end_date).drop("user_id")
        heads = self.runs(user_id, start_date, end_date, model_used)
        return rows.join(heads.select("run_id", "user_id", "model_used", "forecast_horizon"), "run_id")

    def settings(self) -> DataFrame:
        users = self._read("gone_users", GONE_USER_SCHEMA).groupBy("user_id").agg(F.max("before_seq").alias("before_seq"))
        written = self._read("settings", SETTING_SCHEMA).join(users, "user_id", "left")
        return history.latest_settings(written.filter("before_seq IS NULL OR inserted_seq > before_seq").drop("before_seq"))


class RunStore:
    def __init__(self, spark: SparkSession, root: str, spec: PanelSpec):
        self.spark, self.spec = spark, spec
        self.versions = Versions(spark, root)

    def view(self, version: int | None = None) -> RunView:
        """The newest version, or a given one; the view stays with it."""
        return RunView(self.versions, self.spec, self.versions.head() if version is None else version)

    # -- writing -----------------------------------------------------------------

    def stage(self, runs: DataFrame, rows: DataFrame) -> dict[str, str]:
        """Write headers and rows without making them part of the store.

        Headers need ``run_id``, ``user_id`` and ``model_used``; what else is missing is NULL, a missing time is now.
        Rows need ``run_id``; rows of a run without a header are refused.  Nothing is written of a batch with a blank
        model label or a repeated run id.
        """
        missing = [c for c in ("run_id", "user_id", "model_used") if c not in runs.columns]
        if missing:
            raise PanelValidationError(f"Run headers lack column(s): {', '.join(missing)}.")
        blank = F.coalesce(F.length(F.trim("model_used")), F.lit(0)) == 0
        if not runs.filter(blank).isEmpty():
            raise PanelValidationError("A run record has no model label.")
        if not runs.groupBy("run_id").count().filter("count > 1 OR run_id IS NULL").isEmpty():
            raise PanelValidationError("Run ids of a batch must be given and differ.")
        if not rows.join(runs, "run_id", "left_anti").isEmpty():
            raise PanelValidationError("There are forecast rows without a run.")
        stamped = F.concat(F.translate(now().cast("string"), " ", "T"), F.lit("+00:00"))
        defaults = {"timestamp": stamped, "inserted_seq": F.lit(_stamp()), "batch_row": F.monotonically_increasing_id()}
        full = runs.withColumns({c: v for c, v in defaults.items() if c not in runs.columns}).withColumn("model_used", F.trim("model_used"))
        wanted = self.spark.createDataFrame([], HEADER_SCHEMA)
        shaped = wanted.unionByName(full.select(*[c for c in wanted.columns if c in full.columns]), allowMissingColumns=True)
        place = {"month": month_of(history.day_of_run()), "user_bucket": bucket(F.col("user_id"))}
        heads = shaped.withColumns(place)
        staged = {"runs": self.versions.stage("runs", heads, **LAID_OUT)}
        # Rows take the place of their header as it was written.
        written = self.spark.read.schema(f"{HEADER_SCHEMA}, {PLACE_SCHEMA}").parquet(staged["runs"])
        wanted = self.spark.createDataFrame([], row_schema(self.spec))
        told = rows.drop("user_id", *PLACE).join(written.select("run_id", "user_id", *PLACE), "run_id")
        shaped = wanted.unionByName(told.select(*[c for c in wanted.columns if c in told.columns], *PLACE), allowMissingColumns=True)
        return staged | {"forecast_rows": self.versions.stage("forecast_rows", shaped, **LAID_OUT)}

    def append(self, runs: DataFrame, rows: DataFrame) -> int:
        """Append runs with their forecast rows, seen together or not at all."""
        return self.versions.append(self.stage(runs, rows))

    def delete_runs(self, pairs: DataFrame) -> int:
        """Delete runs listed as ``(user_id, run_id)``; a run of another user stays (L3)."""
        return self.versions.append({"gone": self.versions.stage("gone", pairs.select("user_id", "run_id"))})

    def delete_users(self, users: DataFrame) -> int:
        """Delete users with all runs and settings they have now (G5); what they write later counts again."""
        gone = users.select(F.col("user_id").cast("bigint").alias("user_id"), F.lit(_stamp()).alias("before_seq"))
        return self.versions.append({"gone_users": self.versions.stage("gone_users", gone)})

    def put_settings(self, changes: DataFrame) -> int:
        """Upsert settings: append; the newest row of a user counts (L4)."""
        marks = {"updated_at": now(), "inserted_seq": F.lit(_stamp()), "batch_row": F.monotonically_increasing_id()}
        shaped = history.normalised_settings(changes.withColumns({c: v for c, v in marks.items() if c not in changes.columns}))
        return self.versions.append({"settings": self.versions.stage("settings", shaped.select("user_id", "default_model", *marks))})

    def compact(self) -> int:
        """Rewrite what is left as a new version (L6: labels of settings are known ones from then on)."""
        base = self.view()
        place = {"month": month_of(history.day_of_run()), "user_bucket": bucket(F.col("user_id"))}
        runs = base.runs().withColumns(place)
        kept = self._kept_rows(base)
        marks = {"inserted_seq": F.lit(_stamp()), "batch_row": F.monotonically_increasing_id()}
        settings = history.migrated_settings(base.settings()).withColumns(marks)
        staged = {
            "runs": self.versions.stage("runs", runs, **LAID_OUT),
            "forecast_rows": self.versions.stage("forecast_rows", kept, PLACE[:1], dealt=True),
            "settings": self.versions.stage("settings", settings),
        }
        return self.versions.replace(staged, ("gone", "gone_users"), base.version)

    def _kept_rows(self, base: RunView) -> DataFrame:
        """Forecast rows of the runs that are left, dealt and sorted by place.

        Rows are shuffled once, by place: a run that is left is marked in every place where it has a header, and its rows
        meet the mark there.  Where a place holds too many rows for a task, all are cut by run.
        """
        rows = self.versions.read("forecast_rows", f"{row_schema(self.spec)}, {PLACE_SCHEMA}", base.version)
        heads = self.versions.read("runs", f"{HEADER_SCHEMA}, {PLACE_SCHEMA}", base.version).select("run_id", *PLACE)
        marks = heads.join(base.runs().select("run_id"), "run_id", "left_semi")
        largest = rows.groupBy(*PLACE).count().agg(F.max("count")).first()[0] or 0
        cut = F.pmod(F.xxhash64("run_id"), F.lit(max(1, -(-largest // PLACE_ROWS))))
        both = rows.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
        both = both.withColumn("_cut", cut).repartition(*PLACE, "_cut")
        left = F.max("_mark").over(Window.partitionBy(*PLACE, "_cut", "run_id"))
        return both.withColumn("_left", left).filter("_left AND NOT _mark").select(*rows.columns)
