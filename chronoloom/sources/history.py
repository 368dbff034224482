"""The stored history of forecast runs (A5-A8, A12, L, G5).

Runs are append-only parquet, partitioned by a bucket of the user, so one
user's reads touch one bucket.  Writes are rebalanced: small buckets share a
task, and the bucket of a user with very many runs is split over several.  A delete appends a tombstone instead of
rewriting the table; reads leave tombstoned runs out, and :meth:`compact`
writes the surviving rows to a new place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans import history
from chronoloom.spec import PanelValidationError

BUCKETS = 64
RUN_SCHEMA = (
    "run_id string, user_id bigint, timestamp string, model_used string, results string, "
    "dataset_name string, upload_date string, avg_aqi double, risk_level string, "
    "dataset_csv binary, prediction_csv binary, details string, inserted_seq bigint, batch_row bigint"
)
TOMBSTONE_SCHEMA = "user_id bigint, run_id string"
SETTING_SCHEMA = "user_id bigint, default_model string, updated_at timestamp_ntz, inserted_seq bigint, batch_row bigint"


def bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("bigint")), F.lit(BUCKETS)).cast("int")


def now() -> Column:
    """Current UTC time as ``timestamp_ntz``."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading -----------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        """A stored table with the columns it should have; older files may lack some."""
        try:
            # A stated schema gives NULL for what a file lacks, without reading every footer.
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], schema)
            raise

    def runs(self, user_id: int | None = None) -> DataFrame:
        """Runs that were not deleted, of one user or of all."""
        stored = self._read("runs", f"{RUN_SCHEMA}, user_bucket int")
        gone = self._read("deleted", TOMBSTONE_SCHEMA)
        if user_id is not None:
            # A table written before there were buckets has none.
            in_bucket = F.col("user_bucket").isNull() | (F.col("user_bucket") == bucket(F.lit(user_id)))
            stored = stored.filter(in_bucket)
            stored = stored.filter(F.col("user_id") == user_id)
            gone = gone.filter(F.col("user_id") == user_id)
        stored = stored.drop("user_bucket")
        return history.without_deleted(stored, gone.select("user_id", "run_id"))

    def settings(self) -> DataFrame:
        return history.latest_settings(self._read("settings", SETTING_SCHEMA))

    # -- writing -----------------------------------------------------------------

    def append_runs(self, runs: DataFrame, any_text: bool = True) -> None:
        """Append run records (A6, A7); missing optional columns are NULL.

        Needs ``user_id``, ``model_used`` and ``results``.  A blank model label
        is refused before anything is written, and so is a payload that is not JSON
        unless ``any_text`` is set, as for records moved from elsewhere (C15).
        """
        missing = [c for c in ("user_id", "model_used", "results") if c not in runs.columns]
        if missing:
            raise PanelValidationError(f"Run records lack column(s): {', '.join(missing)}.")
        blank = F.coalesce(F.length(F.trim("model_used")), F.lit(0)) == 0
        if not runs.filter(blank).isEmpty():
            raise PanelValidationError("A run record has no model label.")
        if not any_text and not runs.filter(F.try_parse_json(F.col("results")).isNull()).isEmpty():
            raise PanelValidationError("A run record's payload is not JSON.")
        stamped = F.concat(F.translate(now().cast("string"), " ", "T"), F.lit("+00:00"))
        # Later batches sort after earlier ones; the row number keeps the order inside a batch.
        started = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1_000_000)
        defaults = {
            "run_id": F.expr("uuid()"),
            "timestamp": stamped,
            "inserted_seq": F.lit(started),
            "batch_row": F.monotonically_increasing_id(),
        }
        full = runs.withColumns({c: v for c, v in defaults.items() if c not in runs.columns})
        full = full.withColumn("model_used", F.trim("model_used"))
        shaped = self.spark.createDataFrame([], RUN_SCHEMA).unionByName(full, allowMissingColumns=True)
        (
            shaped.withColumn("user_bucket", bucket(F.col("user_id")))
            .hint("rebalance", "user_bucket")
            .write.mode("append")
            .partitionBy("user_bucket")
            .parquet(f"{self.root}/runs")
        )

    def delete_run(self, user_id: int, run_id: str) -> None:
        """Delete one run of its owner; a run of another user stays (L3)."""
        self.delete_runs(self.spark.createDataFrame([(user_id, run_id)], TOMBSTONE_SCHEMA))

    def delete_runs(self, pairs: DataFrame) -> None:
        """Delete the runs listed as ``(user_id, run_id)``."""
        pairs.select("user_id", "run_id").write.mode("append").parquet(f"{self.root}/deleted")

    def delete_user(self, user_id: int) -> None:
        """Delete all runs a user has now."""
        self.delete_runs(self.runs(user_id))

    def put_settings(self, changes: DataFrame) -> None:
        """Upsert settings: append; the newest row of a user counts (L4)."""
        started = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1_000_000)
        marks = {"updated_at": now(), "inserted_seq": F.lit(started), "batch_row": F.monotonically_increasing_id()}
        shaped = history.normalised_settings(changes.withColumns(marks))
        shaped.select("user_id", "default_model", *marks).write.mode("append").parquet(f"{self.root}/settings")

    def compact(self, new_root: str) -> "HistoryStore":
        """Write the surviving rows to a new root and return the store there."""
        (
            self.runs()
            .withColumn("user_bucket", bucket(F.col("user_id")))
            .hint("rebalance", "user_bucket")
            .write.partitionBy("user_bucket")
            .parquet(f"{new_root}/runs")
        )
        self.settings().write.parquet(f"{new_root}/settings")
        return HistoryStore(self.spark, new_root)
