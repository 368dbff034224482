"""Substring dedup: recurring passages found by automata over routed stretches of all documents.

A passage recurs if SPAN consecutive words stand at two places.  Of all its places only the first (smallest document
id, then earliest start) keeps them.

1. Every window of SPAN words is represented by its smallest hashed GRAM of words; equal windows have equal
   representatives.  Representatives met once in the corpus end here (``recurring``).
2. Each document's windows with a recurring representative form stretches of at most 2 * SPAN - GRAM words.  A stretch
   goes to the shard of its representative, so a document is streamed past just the shards that can hold its passages,
   and the work grows with the input (``stretches``).
3. In a shard, windows met twice are confirmed and compiled into an Aho-Corasick automaton over word codes; all stretches
   of the shard are streamed through it, which gives every occurrence, word for word (``locate``).
4. A representative with very many places is dealt over several shards; what is first in one of these is compared with
   the others by a pre-aggregated minimum.
5. Occurrences that are not first cover words, which ``remove`` takes out.

A null text has no words.  A row without id keeps all its words and takes none from others.  Rows with equal ids are
judged each by its own words (``row``, a hash of the text, tells them apart); of equal windows in two of them the
earlier start is first, and at one start both are.  Equal rows lose the same words.  A long text is one row of its batch
and is hashed in one piece.  Only id and text are read.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import byte_texts, chunks, grams, release, word_hashes
from chronoloom.session import durable

SPAN, GRAM = 20, 8
#: Stretches in a shard, on average; a representative with more than HOT places is dealt over several shards.
SHARD, HOT = 8000, 2000
_PLACE = np.uint64((1 << 28) - 1)


def representatives(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: place and hash of each representative, and the first and last window that it stands for."""
    width = SPAN - GRAM + 1
    for low, high in chunks(texts):
        h, begins = word_hashes(texts[low:high])
        g = grams(h, GRAM)
        if len(g) < width:
            for _ in range(low, high):
                yield tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
            continue
        # Hash in the high bits, place in the low ones: the minimum is the leftmost smallest.
        packed = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        two = np.minimum(packed[:-1], packed[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        least = np.minimum(eight[: len(g) - width + 1], eight[width - 8 : len(g) - 7])
        place = (least & _PLACE).astype(np.int64)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a < SPAN:
                yield tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
                continue
            own = place[a : b - SPAN + 1]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.append(first[1:], len(own)) - 1
            yield own[first] - a, g[own[first]], first, last


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, n) of representatives with several places, and (doc_id, row, places) of each document's ones."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r[1] for r in representatives(byte_texts(batch.column(0)))]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = list(representatives(byte_texts(batch.column(2))))
            size = [len(r[0]) for r in found]
            yield pa.record_batch(
                [
                    pa.array(np.repeat(ids, size), pa.int64()),
                    pa.array(np.repeat(own, size), pa.int64()),
                    pa.array(np.concatenate([r[0] for r in found]), pa.int32()),
                    pa.array(np.concatenate([r[1] for r in found]).view(np.int64)),
                ],
                names=["doc_id", "row", "place", "h"],
            )

    spark = docs.sparkSession
    counts = durable(docs.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    release(spark)
    every = docs.where("doc_id IS NOT NULL").mapInArrow(placed, "doc_id long, row long, place int, h long")
    places = every.join(counts, "h").groupBy("doc_id", "row").agg(F.collect_list(F.struct("place", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))).alias("places"))
    places = durable(places)
    release(spark)
    return counts, places


def stretches(docs: DataFrame, places: DataFrame, shards: int) -> DataFrame:
    """(shard, hot, doc_id, row, start, words) of all windows whose representative recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(2))
            shard, hot, ids, own, starts, parts = [], [], [], [], [], []
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (doc, row), text, wanted, rep in zip(named, texts, batch.column(3).to_pylist(), representatives(texts), strict=True):
                words = text.split()
                many = {w["place"]: w["n"] for w in wanted}
                for p, h, a, b in zip(*(x.tolist() for x in rep), strict=True):
                    n = many.get(p)
                    if n:
                        is_hot = n > HOT
                        # A hot representative has shards of its own, which its documents are dealt over.
                        shard.append(h % shards if not is_hot else -1 - (h * 31 + doc * 0x9E3779B1 % (n // HOT + 1)) % (1 << 62))
                        hot.append(is_hot)
                        ids.append(doc)
                        own.append(row)
                        starts.append(a)
                        parts.append(b" ".join(words[a : b + SPAN]))
            yield pa.record_batch(
                [pa.array(shard, pa.int64()), pa.array(hot, pa.bool_()), *(pa.array(x, pa.int64()) for x in (ids, own, starts)), pa.array(parts, pa.binary())],
                names=["shard", "hot", "doc_id", "row", "start", "words"],
            )

    joined = docs.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places")
    return joined.mapInArrow(run, "shard long, hot boolean, doc_id long, row long, start long, words binary")


def _coded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all stretches, each ended by a 1; and where each begins.  Codes are code points."""
    codes: dict[bytes, int] = {}
    split = [p.split(b" ") for p in parts]
    sizes = np.array([len(s) + 1 for s in split])
    flat = np.fromiter((codes.setdefault(w, len(codes)) for s in split for w in (*s, b"")), np.int64, int(sizes.sum()))
    end = codes[b""]
    # Surrogates are no characters, so they are stepped over.
    points = flat + 0x100
    points[points >= 0xD800] += 0x800
    if len(codes) + 0x900 > 0x110000:
        raise ValueError(f"{len(codes)} words in one shard: choose a smaller SHARD")
    points[flat == end] = 1
    return points.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])


def occurrences(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, offset, pattern) of every window that stands twice among the stretches, in stretch order."""
    import ahocorasick

    points, begins = _coded(parts)
    h = grams(points.astype(np.uint64), SPAN)
    # A window over the end of a stretch is none.
    ends = np.cumsum(points == 1)
    inside = np.flatnonzero(ends[SPAN - 1 :] == np.concatenate([[0], ends[:-SPAN]])) if len(points) >= SPAN else np.zeros(0, np.int64)
    values, first, counts = np.unique(h[inside], return_index=True, return_counts=True)
    text = points.tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, at in enumerate(inside[first[counts > 1]].tolist()):
        automaton.add_word(text[at : at + SPAN], k)
    if not len(automaton):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    automaton.make_automaton()
    found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    at = found[:, 0] - SPAN + 1
    stretch = np.searchsorted(begins, at, "right") - 1
    return stretch, at - begins[stretch], found[:, 1]


def locate(routed: DataFrame) -> DataFrame:
    """Covering windows as (doc_id, row, begin, stop, key): key is null where a window certainly is not the first, and else
    the window's digest, in hot shards only."""

    def run(group: pa.Table) -> pa.Table:
        ids, own, starts = (group.column(c).to_numpy() for c in ("doc_id", "row", "start"))
        order = np.lexsort((own, starts, ids))
        ids, own, starts = ids[order], own[order], starts[order]
        parts = group.column("words").take(pa.array(order)).to_pylist()
        stretch, offset, pattern = occurrences(parts)
        # Occurrences come in order of document and start, so a pattern's first one is its first place.
        doc, at = ids[stretch], starts[stretch] + offset
        _, first, inverse = np.unique(pattern, return_index=True, return_inverse=True)
        later = (doc != doc[first][inverse]) | (at != at[first][inverse])
        d, r, a = doc[later], own[stretch][later], at[later]
        by_row = np.lexsort((a, r, d))
        d, r, a = d[by_row], r[by_row], a[by_row]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] > a[:-1] + 1)])) if len(d) else np.zeros(0, np.int64)
        stop = a[np.append(new[1:], len(a)) - 1] + SPAN if len(d) else np.zeros(0, np.int64)
        out = [d[new].tolist(), r[new].tolist(), a[new].tolist(), stop.tolist(), [None] * len(new)]
        if group.column("hot")[0].as_py():
            gone = set(zip(stretch[later].tolist(), offset[later].tolist(), strict=True))
            for s, part in enumerate(parts):
                words = part.split(b" ")
                for o in range(len(words) - SPAN + 1):
                    if (s, o) not in gone:
                        begin = int(starts[s]) + o
                        key = hashlib.blake2b(b" ".join(words[o : o + SPAN]), digest_size=16).digest()
                        for column, x in zip(out, (int(ids[s]), int(own[s]), begin, begin + SPAN, key), strict=True):
                            column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "row", "begin", "stop", "key"])

    return routed.groupBy("shard").applyInArrow(run, "doc_id long, row long, begin long, stop long, key binary")


def covered_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans): word ranges of each document that stand at an earlier place, too."""
    spark = docs.sparkSession
    counts, places = recurring(docs)
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = durable(locate(stretches(docs, places, total // SHARD + 1)))
    release(spark)
    firsts = found.where("key IS NOT NULL")
    least = firsts.groupBy("key").agg(F.min(F.struct("doc_id", "begin")).alias("least"))
    late = firsts.join(least, "key").where("doc_id != least.doc_id OR begin != least.begin")
    every = found.where("key IS NULL").drop("key").unionAll(late.select("doc_id", "row", "begin", "stop"))
    spans = durable(every.groupBy("doc_id", "row").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")))
    release(spark)
    return spans


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words outside all spans, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if spans:
                    stays = np.ones(len(words), bool)
                    for s in spans:
                        stays[s["begin"] : s["stop"]] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return docs.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words that stand in a recurring passage at an earlier place."""
    docs = _picked(docs, id_col, text_col)
    return remove(docs, covered_spans(docs))
