"""Tables that change together, in numbered versions that readers can hold on to.

Data folders are written first and belong to nothing.  A version is a manifest, one small file that names the folders
of every table; it appears in one rename, so a commit is seen by all tables at once or not at all, and what a writer
left half done is never read.  Folders are not changed after their commit: a reader of an older version goes on reading
it.  Writers go by turns: a version number is taken by the manifest that stood there first, and the other writer builds
its change again on the new head.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Manifest = dict[str, list[str]]
MANIFEST_SCHEMA = "commit string, tables map<string,array<string>>"
ATTEMPTS = 20


class ConcurrentCommitError(RuntimeError):
    """Other writers took every version number that was tried, or the head moved under a rewrite."""


def _missing(exc: AnalysisException) -> bool:
    return exc.getCondition() == "PATH_NOT_FOUND"


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def head(self) -> int:
        """Number of the newest version; 0 where nothing was committed."""
        try:
            newest = self.spark.read.schema("commit string, v int").json(f"{self.root}/versions").agg(F.max("v")).first()[0]
        except AnalysisException as exc:
            if _missing(exc):
                return 0
            raise
        return newest or 0

    def _first_manifest(self, version: int):
        files = self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/versions/v={version}")
        return files.orderBy("_metadata.file_modification_time", "commit").first()

    def manifest(self, version: int) -> Manifest:
        if version == 0:
            return {}
        return {name: list(paths) for name, paths in self._first_manifest(version)["tables"].items()}

    def stage(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = (), dealt: bool = False) -> str:
        """Write rows of a table; they are part of no version until a commit names the folder.

        Rows that agree in the columns given lie together, sorted by them: small groups share a task and a file, and a
        group too large for a task is split.  ``dealt`` says that the rows lie so already.
        """
        path = f"{self.root}/{name}/commit={uuid.uuid4().hex}"
        together = [*partition_by, *cluster_by]
        if together and not dealt:
            df = df.hint("rebalance", *together).sortWithinPartitions(*together)
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
        return path

    def commit(self, change: Callable[[Manifest], Manifest], base: int | None = None) -> int:
        """Make ``change`` of the head's manifest the next version; with ``base`` only if that is still the head."""
        mine = uuid.uuid4().hex
        for _ in range(ATTEMPTS):
            head = self.head()
            if base is not None and head != base:
                raise ConcurrentCommitError(f"Version {base} was rewritten, but {head} is the newest now.")
            tables = change(self.manifest(head))
            row = self.spark.createDataFrame([(mine, tables)], MANIFEST_SCHEMA).coalesce(1)
            try:
                row.write.json(f"{self.root}/versions/v={head + 1}")
            except AnalysisException as exc:
                if exc.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
            if self._first_manifest(head + 1)["commit"] == mine:
                return head + 1
        raise ConcurrentCommitError(f"No version was free in {ATTEMPTS} attempts.")

    def append(self, staged: dict[str, str], base: int | None = None) -> int:
        """A version with the staged folders added, one for each table named."""
        return self.commit(lambda now: now | {n: [*now.get(n, []), path] for n, path in staged.items()}, base)

    def replace(self, staged: dict[str, str], dropped: tuple[str, ...], base: int) -> int:
        """A version in which the staged folders stand for whole tables, and some tables are empty."""
        return self.commit(lambda now: {n: p for n, p in now.items() if n not in dropped} | {n: [p] for n, p in staged.items()}, base)

    def read(self, name: str, schema: str, version: int) -> DataFrame:
        """A table as it is in a version, with the columns it should have; older folders may lack some."""
        paths = self.manifest(version).get(name)
        if not paths:
            return self.spark.createDataFrame([], schema)
        # A stated schema gives NULL for what a file lacks, without reading every footer.
        return self.spark.read.schema(f"{schema}, commit string").option("basePath", f"{self.root}/{name}").parquet(*paths).drop("commit")
