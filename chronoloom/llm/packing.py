"""Packing of token sequences: best-fit decreasing with a segment tree over remaining capacities.

``tokenize`` cuts every document's ids into full windows and one rest; ``pack`` gives every piece its sequence.  Full
windows are sequences of their own.  The rests are dealt into shards of bounded size; in each, pieces go from the
longest to the shortest into the tightest open window, which a segment tree indexed by remaining capacity finds in
log(capacity) steps.  A shard leaves at most a few windows part empty, so the padding of a corpus stays small.

Null text is empty: the document is its end id alone.  Equal lengths go by document id, then by the piece's start.
Repeated rows are packed like any others.  Other columns are not read, whatever their names.  No documents, no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import byte_texts
from chronoloom.session import durable

CAPACITY = 4096
END_ID = 2
SHARD_PIECES = 50_000
#: Words kept with their ids; beyond it a worker starts a new memory.
MEMORY_WORDS = 1_500_000
# How the tokenizer splits a lower-case word, for words of ASCII signs and composed Latin letters only.
PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+|[0-9]|[!-/:-`{-~]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Numbers(dict):
    """Numbers of words in order of first sight; ``fresh`` holds the words numbered since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, word: bytes | str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class IdLists:
    """Lists of ids by number, end to end in one array."""

    def __init__(self) -> None:
        self.begins = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])

    def joined(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists numbered ``k`` joined, and the size of each."""
        sizes = self.begins[k + 1] - self.begins[k]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.begins[k] - ends + sizes, sizes)], sizes


class Encoder:
    """Ids of texts; the ids of each word between ASCII white space, and of each part of a word, are remembered.

    The tokenizer splits at white space before anything else and never joins over it, so ids of a text are the ids of
    its words in order.  It then splits words into runs of letters, digits and other signs.  Where case and composition
    of letters leave no doubt (``PLAIN``), words are split the same way here, as many new words consist of known parts.
    A word that holds a token added to the vocabulary is never split: the tokenizer finds such tokens first.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(a.content) for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.reset()

    def reset(self) -> None:
        self.words, self.word_ids = Numbers(), IdLists()
        self.parts, self.part_ids = Numbers(), IdLists()

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has: they go as one text, which is twice as fast, and are told apart by place."""
        whole = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in parts])
        at = np.array([o[0] for o in whole.offsets], np.int64)
        return np.array(whole.ids, np.uint32), np.diff(np.searchsorted(at, ends), prepend=0)

    def _learn(self) -> None:
        fresh = [w.decode() for w in self.words.fresh]
        self.words.fresh.clear()
        split = [PART.findall(w.lower()) if PLAIN.fullmatch(w) and not self.added.search(w) else [w] for w in fresh]
        counts = np.array([len(s) for s in split], np.int64)
        k = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        new = self.parts.fresh
        for low in range(0, len(new), 2000):
            self.part_ids.add(*self._together(new[low : low + 2000]))
        new.clear()
        ids, sizes = self.part_ids.joined(k)
        self.word_ids.add(ids, np.add.reduceat(sizes, np.cumsum(counts) - counts))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > MEMORY_WORDS:
            self.reset()
        split = [t.split() for t in texts]
        counts = [len(s) for s in split]
        k = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        if self.words.fresh:
            self._learn()
        ids, size = self.word_ids.joined(k)
        ends = np.concatenate([[0], np.cumsum(size)])
        return np.split(ids, ends[np.cumsum(counts, dtype=np.int64)[:-1]])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, whose memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ids (unsigned 32-bit, little-endian)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(path)
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = byte_texts(batch.column(1))
            for low in range(0, len(texts), 100):
                rows: list[tuple] = []
                for name, ids in zip(names[low : low + 100], encoder.encode(texts[low : low + 100]), strict=True):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((name, start, len(piece), len(ids), piece.tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """A segment tree whose leaf c says whether a window with c free places is open."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, free: int, value: int) -> None:
        node = free + self.size
        self.any[node] = value
        while node > 1:
            node //= 2
            value = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == value:
                break
            self.any[node] = value

    def add(self, free: int, window: int) -> None:
        if not self.open[free]:
            self._set(free, 1)
        self.open[free].append(window)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least free places that holds ``length``, removed from the tree."""
        node = length + self.size
        if not self.any[node]:
            # Up until a right neighbour has something, then down its left side.
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        free = node - self.size
        window = self.open[free].pop()
        if not self.open[free]:
            self._set(free, 0)
        return free, window


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces come in decreasing length."""
    tree, used = CapacityTree(capacity), 0
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        got = tree.take(n)
        if got is None:
            free, w = capacity, used
            used += 1
        else:
            free, w = got
        window[i], offset[i] = w, capacity - free
        if free > n:
            tree.add(free - n, w)
    return window, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (their columns are kept)."""
    rests = pieces.where(F.col("length") < capacity)
    shards = rests.count() // SHARD_PIECES + 1
    spread = F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("start").to_numpy(), group.column("doc_id").to_numpy(), -group.column("length").to_numpy()))
        group = group.take(pa.array(order))
        window, offset = best_fit(group.column("length").to_numpy(), capacity)
        # Even ids belong to shards, odd ids to full windows.
        ids = ((np.int64(key[0].as_py()) << np.int64(24)) + window) * 2
        group = group.drop_columns(["shard"])
        return group.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = rests.withColumn("shard", spread).groupBy("shard").applyInArrow(run, f"{schema}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    return packed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The token sequences themselves: the ids of their pieces, joined by offset (at most ``capacity`` ids each)."""
    placed = packed.select("doc_id", "start", "sequence_id", "offset").join(pieces.select("doc_id", "start", "ids"), ["doc_id", "start"])
    return placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with the checksum of their ids, their sequence and their place in it."""
    pieces = tokenize(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(durable(pieces))
