"""WARC archives: writing, reading back, and merging their indexes into ordered capture histories.

``write_archives`` makes records of gzip members; every task writes its own files into a folder that all executors share
and returns where each record stands.  ``read_archives`` streams the files back and checks each record against its digest.
``write_runs`` sorts what a task has read, RUN_RECORDS captures at a time, and writes each run to the shared folder as a
file of small batches.  ``merge_runs`` cuts the key space into ranges; a task finds its slice in every run by binary
search over the batches and merges the slices with a loser tree, one batch of each run in memory.  Where there are more
than FAN runs, groups of about FAN are merged into longer runs first.  Nothing is sorted or shuffled after the runs are
written, and captures come out in global order, range by range.  ``deduplicate`` names, for equal payloads, the capture
that the others revisit; in the archives all records are of type ``resource``, as this is known only after reading.

A run file that a lost task leaves behind is not in the catalogue of runs and is never read.

Null html is an empty payload, null url an empty one.  Repeated rows are captures of their own; of equal payloads and
equal ids one is the response.  Only id, url and html are read.  An empty table writes no record.
A very long page is one record, read and written in one piece.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import durable, scratch_path

EPOCH = datetime(2020, 1, 1)
RUN_RECORDS = 20_000
#: Captures in a batch of a run file, runs merged into one, and captures in a range, on average.
BATCH, FAN, RANGE_ROWS = 200, 256, 100_000
#: Keys that the ranges are cut by come from about so many batches, whatever the size of the input.
SPLIT_KEYS = 10_000
INDEX_SCHEMA = "file string, begin long, size long"
CATALOGUE_SCHEMA = "run string, batch int, n int, url_key string, captured string, page_id long"
_CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("begin", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)
_CAPTURE_SQL = "url_key string, captured string, page_id long, file string, begin long, payload_bytes long, payload_digest string"


def url_key(url: str) -> str:
    """Host parts reversed, then the rest: ``com,example)/path?query``."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.lower().removeprefix("www.").split(":")[0]
    return ",".join(reversed(host.split("."))) + ")/" + path.lower() if slash or host else ""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, captured: str, page_id: int | None, payload: bytes, name: str) -> bytes:
    """One gzip member with a WARC/1.1 resource record."""
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\n"
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\n"
        f"WARC-Target-URI: {url}\r\nWARC-Date: {captured}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n"
        f"WARC-Payload-Digest: sha1:{digest(payload)}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages into archives below ``folder``; returns the place of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        serial, rows, out, name, at = 0, [], None, "", 0

        def close() -> pa.RecordBatch:
            nonlocal out, rows
            out.close()
            out = None
            written, rows = zip(*rows, strict=True), []
            kinds = (pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(written, kinds, strict=True)], names=["file", "begin", "size"])

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # A task that is tried again writes files of its own; the index names only those of one attempt.
                    name, at = f"{context.partitionId():06d}-{serial:04d}-{context.taskAttemptId()}.warc.gz", 0
                    out, serial = store.open_output_stream(f"{root}/{name}", compression=None), serial + 1
                payload, target = (html or "").encode(), (url or "").replace("\r", "%0D").replace("\n", "%0A")
                captured = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = record(target, captured, page_id, payload, f"{name}/{at}")
                out.write(member)
                rows.append((name, at, len(member)))
                at += len(member)
                if len(rows) == RUN_RECORDS:
                    yield close()
        if out is not None:
            yield close()

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, INDEX_SCHEMA)


def read_archives(index: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records, streamed from their files: page id, URL, capture time, payload size and digest as read.

    Files are dealt to tasks by name, so a file is read once and in its own order; each record's payload must have its
    stored digest.  The number of tasks is stated: the places are few bytes, and the files behind them many.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        source, opened = None, ""
        for batch in batches:
            rows = []
            for name, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != opened:
                    source, opened = store.open_input_file(f"{root}/{name}"), name
                source.seek(begin)
                headers, payload = parse(source.read(size))
                found = digest(payload)
                if headers["WARC-Payload-Digest"] != f"sha1:{found}":
                    raise ValueError(f"{name} at {begin}: payload does not match its digest")
                page_id = headers["X-Page-Id"].strip()
                rows.append((url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], int(page_id) if page_id else None, name, begin, len(payload), found, payload if keep_payload else None))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["url_key", "captured", "page_id", "file", "begin", "payload_bytes", "payload_digest", "payload"],
            )

    schema = "url_key string, captured string, page_id long, file string, begin long, payload_bytes long, payload_digest string, payload binary"
    placed = index.select("file", "begin", "size").repartition(parts, "file").sortWithinPartitions("file", "begin")
    return placed.mapInArrow(run, schema)


class LoserTree:
    """Merges sorted iterators: each step replays one path of the tree."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key = runs, key
        self.n = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.n
        for i in range(self.n):
            self._replay(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (self.key(a), i) < (self.key(b), j)

    def _replay(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (row := self.heads[w := self.tree[0]]) is not None:
            yield row
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _order(row: tuple) -> tuple:
    """What captures are ordered by: key, time, id (none first)."""
    return row[0], row[1], -1 if row[2] is None else row[2]


def _store_run(rows: Iterator[tuple], folder: str) -> pa.RecordBatch:
    """Writes sorted captures as one run file and gives its entries of the catalogue: the first key of each batch."""
    store, root = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name, entries = f"run-{uuid.uuid4().hex}.arrow", []
    with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, _CAPTURE) as file:
        while held := list(itertools.islice(rows, BATCH)):
            entries.append((name, len(entries), len(held), *held[0][:3]))
            file.write_batch(pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _CAPTURE.types, strict=True)], schema=_CAPTURE))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    columns = zip(*entries, strict=True) if entries else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["run", "batch", "n", "url_key", "captured", "page_id"])


def _slice(store: pa.fs.FileSystem, path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of one run with low <= key < high, one batch at a time; null is no bound."""
    with store.open_input_file(path) as source:
        file = pa.ipc.open_file(source)

        def first(k: int) -> tuple:
            batch = file.get_batch(k)
            return _order(tuple(batch.column(c)[0].as_py() for c in range(3)))

        # The last batch that begins below the bound may hold the first capture of the slice.
        begin = 0 if low is None else max(0, bisect.bisect_left(range(file.num_record_batches), low, key=first) - 1)
        for k in range(begin, file.num_record_batches):
            for row in zip(*(c.to_pylist() for c in file.get_batch(k).columns), strict=True):
                key = _order(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield row


def write_runs(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures locally, RUN_RECORDS at a time, into run files below ``folder``; returns the catalogue of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        while held := list(itertools.islice(rows, RUN_RECORDS)):
            yield _store_run(iter(sorted(held, key=_order)), folder)

    return captures.select(*_CAPTURE.names).mapInArrow(run, CATALOGUE_SCHEMA)


def longer_runs(catalogue: DataFrame, folder: str, groups: int) -> DataFrame:
    """Merges the runs, in ``groups`` groups by their names, into one run a group; returns the catalogue of these."""

    def run(group: pa.Table) -> pa.Table:
        store, root = pa.fs.FileSystem.from_uri(folder)
        slices = [_slice(store, f"{root}/{name}", None, None) for name in group.column("run").to_pylist()]
        return pa.Table.from_batches([_store_run(iter(LoserTree(slices, _order)), folder)])

    names = catalogue.groupBy("run").agg(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group"))
    return names.repartition(groups, "group").groupBy("group").applyInArrow(run, CATALOGUE_SCHEMA)


def merge_runs(catalogue: DataFrame, folder: str) -> DataFrame:
    """The captures of all runs in global order of (url_key, captured, page_id): by ``range``, and by ``place`` in it.

    Ranges are cut at keys of some batches, chosen by a hash; a key with many captures is spread by time and id.  The
    driver holds about SPLIT_KEYS keys and the names of the runs, one for RUN_RECORDS * FAN captures where these are many.
    """
    spark = catalogue.sparkSession
    runs, total, batches = catalogue.agg(F.count_distinct("run"), F.sum("n"), F.count("*")).first()
    if runs > FAN:
        catalogue = durable(longer_runs(catalogue, folder, runs // FAN + 1))
    names = sorted(r.run for r in catalogue.select("run").distinct().collect())
    chosen = catalogue.where(F.pmod(F.xxhash64("run", "batch"), F.lit(batches // SPLIT_KEYS + 1)) == 0)
    keys = sorted({_order(tuple(r)) for r in chosen.select("url_key", "captured", "page_id").collect()})
    parts = max(1, min((total or 0) // RANGE_ROWS + 1, len(keys)))
    edges = [None, *(keys[k * len(keys) // parts] for k in range(1, parts)), None]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for part in (p for batch in given for p in batch.column(0).to_pylist()):
            slices = [_slice(store, f"{root}/{name}", edges[part], edges[part + 1]) for name in names]
            merged, place = iter(LoserTree(slices, _order)), 0
            while held := list(itertools.islice(merged, 5000)):
                columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), _CAPTURE.types, strict=True)]
                where = [pa.array([part] * len(held), pa.int64()), pa.array(range(place, place + len(held)), pa.int64())]
                yield pa.record_batch([*columns, *where], names=[*_CAPTURE.names, "range", "place"])
                place += len(held)

    return spark.range(0, parts, 1, parts).mapInArrow(run, f"{_CAPTURE_SQL}, range long, place long")


def deduplicate(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads the one with the largest page_id is the response.

    The responses are found by a pre-aggregated maximum and joined back, so a payload that many pages share is no
    single group of rows.
    """
    # Of several records with the largest page_id one place in the archives is the response.
    own = F.struct("page_id", *[c for c in ("file", "begin") if c in captures.columns])
    chosen = captures.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max(own).alias("_response")
    )
    joined = captures.join(chosen, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_response.page_id").isNotNull() & ~F.col("_response").eqNullSafe(own)
    return joined.select(
        *captures.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_response.page_id")).alias("refers_to"),
    )


def capture_histories(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back, and merges the runs into one ordered, deduplicated capture history."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    index = durable(write_archives(pages, folder))
    catalogue = durable(write_runs(read_archives(index, folder).drop("payload"), f"{folder}/runs"))
    return deduplicate(durable(merge_runs(catalogue, f"{folder}/runs")))
