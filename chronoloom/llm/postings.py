"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into segments (runs of documents of about SEGMENT_WORDS words); a segment stores, for
each term, the sorted positions of its occurrences.  Segments are written to the shared folder, so a lost executor
costs a re-read.  ``search`` takes phrases (or bags of terms within a distance) and, in every segment, intersects the
offset-adjusted position lists from the phrase's rarest term on; one empty list ends a phrase.

``decontaminate`` indexes the words whose hash bit the benchmark sets in a bitmap of fixed size: a small benchmark needs
few lists, a large one sets all bits and gets them all, on one path.

With a distance, a match ends at any of the phrase's terms and begins at the latest place from which all terms, each as
often as the phrase has it, stand up to there; it counts if it is at most ``slop`` words long.

Words: A-Z lower-cased, maximal runs of 0-9, a-z and characters beyond ASCII.  A null or wordless text has no words and
is never hit; a null or wordless item has no window.  Equal items are all reported.  Repeated document rows are searched
one by one.  Only the id and text columns are read, so other columns may have any name.  Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import byte_texts
from chronoloom.session import durable

WINDOW = 10
SEGMENT_WORDS = 1_000_000
#: A query block: items whose words together stay under this are searched at once (some 20 MB sent to each worker).
BLOCK_WORDS = 500_000
#: Bits of the map that says which words the benchmark may ask for (512 KB).
TERM_BITS = 1 << 22

_KEEP = np.zeros(256, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _KEEP[_c] = _c + 32 if 0x41 <= _c < 0x5B else _c
_TABLE = bytes(int(c) if c else 0x20 for c in _KEEP)

INDEX_SCHEMA = "segment string, term binary, n long, positions binary, ids binary, known binary"
HIT_SCHEMA = (
    "doc_id long, n_words long, spans array<struct<begin:long,stop:long>>, items array<long>, row string"
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_bits(items: DataFrame, text_col: str = "text") -> bytes:
    """A bitmap of TERM_BITS bits: bit crc32(word) is set for every word of the items.  Its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {zlib.crc32(w) % TERM_BITS for text in byte_texts(batch.column(0)) for w in words(text)}
            yield pa.record_batch([pa.array(sorted(found), pa.int64())], names=["bit"])

    picked = items.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, "bit long")
    # Spark's bitmaps hold 32768 bits each, and number them from 1.
    maps = picked.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")
    )
    out = bytearray(TERM_BITS // 8)
    for row in maps.collect():
        at = (row.part - 1) * 4096
        out[at : at + 4096] = row.bits
    return bytes(out)


class _Codes(dict):
    """Numbers words as they come; a word whose bit is not set is -1."""

    def __init__(self, bits: bytes | None) -> None:
        self.bits, self.names = bits, []

    def __missing__(self, word: bytes) -> int:
        k = zlib.crc32(word) % TERM_BITS
        wanted = self.bits is None or self.bits[k >> 3] >> (k & 7) & 1
        self[word] = code = len(self.names) if wanted else -1
        if wanted:
            self.names.append(word)
        return code


def build_index(docs: DataFrame, bits: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of all documents: one row per segment and term, and one per segment (null term) with its documents.

    ``bits`` (see ``term_bits``) restricts the lists to terms that may be asked for; positions always count all words.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Codes(wanted.value)
        part, serial = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        coded: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in coded], np.int64)
            # One position between documents stays empty, so that no phrase runs over the edge.
            begins = np.concatenate([[0], np.cumsum(lengths + 1)])
            codes = np.concatenate([x for c in coded for x in (c, [-1])]).astype(np.int64)
            order = np.argsort(codes, kind="stable")
            order = order[np.searchsorted(codes[order], 0) :]
            kinds, first = np.unique(codes[order], return_index=True)
            lists = np.split(order.astype("<i4"), first[1:]) if len(kinds) else []
            known = np.array([x is not None for x in ids], np.uint8)
            rows = len(kinds) + 1
            name = f"{part}-{serial}"
            return pa.record_batch(
                {
                    "segment": pa.array([name] * rows, pa.string()),
                    "term": pa.array([None, *(vocabulary.names[k] for k in kinds)], pa.binary()),
                    "n": pa.array([int(lengths.sum()), *(len(x) for x in lists)], pa.int64()),
                    "positions": pa.array([begins.astype("<i8").tobytes(), *(x.tobytes() for x in lists)], pa.binary()),
                    "ids": pa.array([np.array([x or 0 for x in ids], "<i8").tobytes()] + [None] * (rows - 1), pa.binary()),
                    "known": pa.array([known.tobytes()] + [None] * (rows - 1), pa.binary()),
                }
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                found = words(text)
                ids.append(i)
                coded.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                total += len(found)
                if total >= SEGMENT_WORDS:
                    yield flush()
                    ids, coded, total, serial = [], [], 0, serial + 1
                    vocabulary = _Codes(wanted.value)
        if ids:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, INDEX_SCHEMA)


def item_windows(texts: list[tuple[int, bytes]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Windows of the items, each with the items that have it; an item under ``size`` words is one window."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for item, text in texts:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            held = out.setdefault(tuple(w[k : k + size]), [])
            if not held or held[-1] != item:
                held.append(item)
    return out


def _positions(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], order: list[int]) -> np.ndarray:
    """Where a phrase begins: offset-adjusted lists are intersected in the given order."""
    at = lists[phrase[order[0]]] - order[0]
    for k in order[1:]:
        there = lists[phrase[k]]
        place = np.minimum(np.searchsorted(there, at + k), len(there) - 1)
        at = at[there[place] == at + k]
        if not len(at):
            break
    return at


def _near(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every match of at most ``slop`` words, the shortest for each last position.

    Each match holds the rarest term, so of the other lists only what lies near to one of its places is looked at.
    """
    need = Counter(phrase)
    nothing = np.zeros(0, np.int64)
    rarest = lists[min(need, key=lambda t: (len(lists[t]) / need[t], t))]
    near: dict[bytes, np.ndarray] = {}
    for t, n in need.items():
        there = lists[t]
        right = np.searchsorted(rarest, there)
        left_gap = there - rarest[np.maximum(right - 1, 0)]
        right_gap = rarest[np.minimum(right, len(rarest) - 1)] - there
        near[t] = there[((left_gap >= 0) & (left_gap < slop)) | ((right_gap >= 0) & (right_gap < slop))]
        if len(near[t]) < n:
            return nothing, nothing
    last = np.sort(np.concatenate(list(near.values())))
    first = last
    for t, n in need.items():
        back = np.searchsorted(near[t], last, "right") - n
        first = np.where(back >= 0, np.minimum(first, near[t][np.maximum(back, 0)]), last - slop)
        good = last - first < slop
        first, last = first[good], last[good]
    return first, last


def _searcher(sent, slop: int | None):  # noqa: ANN001, ANN202
    """Searches one segment for the phrases sent to it."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        lists: dict[bytes, np.ndarray] = {}
        for term, where, ids, known in zip(*(group.column(c).to_pylist() for c in ("term", "positions", "ids", "known")), strict=True):
            if term is None:
                begins, names, sure = np.frombuffer(where, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8)
            else:
                lists[term] = np.frombuffer(where, "<i4").astype(np.int64)
        change = np.zeros(int(begins[-1]) + 1, np.int32)
        hit_items: dict[int, set[int]] = {}
        for phrase, order, held in sent.value:
            if any(phrase[k] not in lists for k in order):
                continue
            if slop is None:
                first = _positions(lists, phrase, order)
                last = first + len(phrase) - 1
            else:
                first, last = _near(lists, phrase, slop)
            doc = np.searchsorted(begins, first, "right") - 1
            inside = last < begins[doc + 1] if len(first) else np.zeros(0, bool)
            np.add.at(change, first[inside], 1)
            np.add.at(change, last[inside] + 1, -1)
            for d in np.unique(doc[inside]).tolist():
                hit_items.setdefault(d, set()).update(held)
        covered = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=np.int8(0))
        starts, stops = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        doc = np.searchsorted(begins, starts, "right") - 1
        spans: dict[int, list[dict[str, int]]] = {}
        for d, s, e in zip(doc.tolist(), starts.tolist(), stops.tolist(), strict=True):
            spans.setdefault(d, []).append({"begin": s - int(begins[d]), "stop": e - int(begins[d])})
        n = len(names)
        return pa.table(
            {
                "doc_id": pa.array([int(x) if k else None for x, k in zip(names, sure, strict=True)], pa.int64()),
                "n_words": pa.array(np.diff(begins) - 1, pa.int64()),
                "spans": pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
                "items": pa.array([sorted(hit_items.get(d, ())) for d in range(n)], pa.list_(pa.int64())),
                "row": pa.array([f"{segment}-{d}" for d in range(n)], pa.string()),
            }
        )

    return run


def search(index: DataFrame, items: DataFrame, size: int = WINDOW, slop: int | None = None, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, the spans that any window covers, and the items with such windows.

    With ``slop`` a window matches wherever all its terms stand within so many words of one document.
    Items are taken in blocks of bounded size, each sent to every task; spans of all blocks are merged.
    """
    spark = index.sparkSession
    cleaned = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    total = cleaned.agg(F.sum(F.length("t") / 2)).first()[0] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    rarity = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    found = None
    for b in range(blocks):
        block = cleaned.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        asked = [(r.i, r.t.encode()) for r in block.collect()]
        windows = item_windows(asked, size)
        terms = {t for w in windows for t in w}
        named = spark.createDataFrame([(bytearray(t),) for t in sorted(terms)], "term binary")
        counts = {bytes(r.term): r.n for r in rarity.join(named, "term").collect()}
        plan = [
            (w, sorted(range(len(w)), key=lambda k, w=w: counts[w[k]]), held)
            for w, held in windows.items()
            if all(t in counts for t in w)
        ]
        sent = spark.sparkContext.broadcast(plan)

        hits = index.groupBy("segment").applyInArrow(_searcher(sent, slop), HIT_SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["begin"], acc["at"]))).alias("n"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: acc["n"],
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The index of the documents, asked for the items' windows."""
    return search(durable(build_index(docs, term_bits(items))), items, size)
