"""Toxicity scores of whole texts by a convolutional network over hashed words.

A word is embedded as the mean of the rows of a table that the hashes of the word and of its beginnings point to, so
that inflected and compound forms share what was learned.  Filters of several widths pass over the words; the maximum
of each over the whole text goes to a logistic output.  The network is trained in numpy: the table starts from how much
more often a word stands in toxic texts, and everything is then fitted by gradients.

Thresholds are calibrated by language on texts that training has not seen: in each language the logit that parts both
classes best (F1) becomes score 0.5.  The language is read off the text itself, from word frequencies of the labelled
texts; languages with too few toxic texts share one threshold.

Learning reads every distinct labelled text, whole.  Word counts are added up by Spark.  Texts are dealt to shards of
bounded size; in each epoch every shard takes its gradient steps from the same network, and the shards' networks are
averaged.  A document with several labels is toxic if any says so; labels that are null are passed over.  Texts of any
length are read, a long one in pieces that keep every window of words.  Null and empty texts have no words and get the score of a text in which no filter fires.  If no
text of one class is known, every score is 1 where only toxic ones are known and else 0.  Repeated rows get equal
scores.  Only id, text and (for learning) language are read, whatever other columns there are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import CHUNK_BYTES, LOWER, byte_texts, chunks, release, running_hash, span_hashes
from chronoloom.session import discard, durable, shuffles_freed

BUCKETS, DIMENSIONS, FILTERS = 1 << 16, 8, 12
WIDTHS = (1, 2, 3)
#: A word's beginnings that are embedded with it, in bytes.
BEGINNINGS = (4, 5, 6, 8)
#: Bytes of text a shard of learning holds, about, and words that are looked at together in a long text.
SHARD_BYTES, PIECE_WORDS = 12 << 20, 1 << 16
#: Numbers that travel in one row when tasks' results are added up.
BLOCK = 1 << 16
#: Held-out logits are told apart up to so many texts; beyond, they are counted on a grid of this step.
EXACT, GRID = 20_000, 1 / 512
EPOCHS, BATCH, RATE = 8, 64, 0.02
#: Smoothing of word counts; toxic texts a language needs for a threshold of its own.
SMOOTH, ENOUGH = 8.0, 8

LETTER = np.zeros(256, np.int8)
LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_SALTS = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & (1 << 64) - 1 | 1) for k in range(1 + len(BEGINNINGS))]
PAD = max(WIDTHS) - 1


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words (word x hash), and where each text's words begin (one more at the end)."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.diff(LETTER[buf], prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = running_hash(buf)
    ends = [end, *(np.minimum(start + n, end) for n in BEGINNINGS)]
    out = np.empty((len(start), len(ends)), np.uint16)
    for k, e in enumerate(ends):
        out[:, k] = span_hashes(total, start, e) * _SALTS[k] >> np.uint64(48)
    return out, np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut where no word is cut."""
    low = 0
    while low < len(text):
        high = low + CHUNK_BYTES
        while high < len(text) and LETTER[LOWER[text[high]]]:
            high += 1
        yield text[low:high]
        low = high


@dataclass
class Network:
    table: np.ndarray  # bucket x dimension
    filters: list[np.ndarray]  # by width: offset x dimension x filter
    bias: np.ndarray  # filter of all widths
    out: np.ndarray
    shift: np.ndarray
    languages: np.ndarray | None = None  # bucket x language: logarithms of frequencies
    thresholds: np.ndarray | None = None  # by language

    @classmethod
    def new(cls, start: np.ndarray, seed: int = 13) -> Network:
        """``start`` is the first dimension of the table; the first filter of each width looks at it alone."""
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        table[:, 0] = start
        filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = np.abs(f[:, 0]) + 0.3
        n = FILTERS * len(WIDTHS)
        return cls(table, filters, np.zeros(n, np.float32), np.full(n, 1 / n, np.float32), np.zeros(1, np.float32))

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """By width: every filter at every word, but for the last ``PAD`` rows."""
        n = len(x) - PAD
        return [sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters]

    def peaks(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each text's words, before bias; ``PAD`` rows follow each text in x."""
        edges = np.stack([begin, np.maximum(end, begin + 1)], 1).ravel()
        parts = []
        for z in self.responses(x):
            # One more row, so that the last text may end where the responses do.
            parts.append(np.maximum.reduceat(np.vstack([z, z[:1]]), edges, 0)[::2])
        return np.where((end > begin)[:, None], np.hstack(parts), -np.inf)

    def logit(self, peaks: np.ndarray) -> np.ndarray:
        return np.maximum(peaks + self.bias, 0) @ self.out + self.shift

    def embed(self, rows: np.ndarray) -> np.ndarray:
        out = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out += self.table[rows[:, k]]
        return out / np.float32(rows.shape[1])

    def laid_out(self, rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded words with ``PAD`` rows of zeros after each text, and the ranges of the texts' words there."""
        texts = np.arange(len(begins) - 1)
        sizes = np.diff(begins)
        begin = begins[:-1] + PAD * texts
        x = np.zeros((len(rows) + PAD * max(len(texts), 1), DIMENSIONS), np.float32)
        x[np.arange(len(rows)) + PAD * np.repeat(texts, sizes)] = self.embed(rows)
        return x, begin, begin + sizes

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages of texts read together."""
        rows, begins = word_rows(texts)
        peaks = self.peaks(*self.laid_out(rows, begins)) if len(rows) else np.full((len(texts), len(self.bias)), -np.inf)
        return self.logit(peaks), self.language(sums(self.languages[rows[:, 0]], begins))

    def read_long(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text read in pieces: the last words of a piece begin their windows in the next one."""
        best = np.full((1, len(self.bias)), -np.inf)
        spoken = np.zeros((1, self.languages.shape[1]))
        carried = np.zeros((0, 1 + len(BEGINNINGS)), np.uint16)
        for piece in pieces(text):
            rows, _ = word_rows([piece])
            spoken += self.languages[rows[:, 0]].sum(0)
            rows = np.vstack([carried, rows])
            carried = rows[-PAD:]
            if len(rows) > PAD:
                best = np.maximum(best, self.peaks(self.embed(rows), np.array([0]), np.array([len(rows) - PAD])))
        if len(carried):
            best = np.maximum(best, self.peaks(*self.laid_out(carried, np.array([0, len(carried)]))))
        return self.logit(best), self.language(spoken)

    def summits(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter over one text's words, before bias, and the first word of its window there."""
        best, at = np.full(len(self.bias), -np.inf), np.zeros(len(self.bias), np.int64)
        for low in range(0, len(rows), PIECE_WORDS):
            x = self.embed(rows[low : low + PIECE_WORDS + PAD])
            n = min(PIECE_WORDS, len(rows) - low)
            z = np.hstack(self.responses(np.vstack([x, np.zeros((n + PAD - len(x), DIMENSIONS), np.float32)])))
            first = z.argmax(0)
            top = z[first, np.arange(len(first))]
            best, at = np.where(top > best, top, best), np.where(top > best, first + low, at)
        return best, at

    def language(self, spoken: np.ndarray) -> np.ndarray:
        """The language that fits best; one past the last for a text without a known word."""
        return np.where(np.ptp(spoken, 1) > 0, spoken.argmax(1), spoken.shape[1])

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages of all texts."""
        logits, languages = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for low, high in chunks(texts):
            one_long = high - low == 1 and len(texts[low]) > CHUNK_BYTES
            logits[low:high], languages[low:high] = self.read_long(texts[low]) if one_long else self.read(texts[low:high])
        return logits, languages

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits, languages = self.judged(texts)
        return sigmoid(logits - self.thresholds[languages])

    def parts(self) -> list[np.ndarray]:
        """What learning moves."""
        return [self.table, *self.filters, self.bias, self.out, self.shift]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, 0, out=total[1:])
    return total[begins[1:]] - total[begins[:-1]]


def weights_of_evidence(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each bucket the smoothed logarithm of how much more often it is met in toxic texts; 0 for those never met.

    ``counts`` are texts by class and bucket, ``n`` all texts by class.
    """
    n = n[:, None].astype(float)
    share = (counts + SMOOTH * n / n.sum()) / n
    return np.log(share[1] / share[0]).astype(np.float32)


def fit(net: Network, squares: list[np.ndarray], docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, begin: int, epochs: int, seed: int) -> None:
    """Gradient steps of the logistic loss, texts weighing by class; only the peaks pass a gradient on.

    ``squares`` belong to ``net.parts()``; both go on from the first ``begin`` epochs.
    """
    rng = np.random.default_rng(seed)
    *filter_squares, bias_square, out_square, shift_square = squares[1:]

    def step(value: np.ndarray, square: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        square[at] += g * g
        value[at] -= RATE * g / np.sqrt(square[at])

    for _ in range(begin):  # the draws of the epochs before
        rng.permutation(len(docs))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            sizes = np.array([len(docs[i]) for i in some])
            if not sizes.any():
                continue
            rows = np.concatenate([docs[i] for i in some])
            begins = np.cumsum(sizes) - sizes
            found = [net.summits(docs[i]) for i in some]
            peaks, where = np.stack([p for p, _ in found]).astype(np.float32), np.stack([w for _, w in found])
            pooled = np.maximum(peaks + net.bias, 0)
            error = ((sigmoid(pooled @ net.out + net.shift) - toxic[some]) * weight[toxic[some]] / len(some)).astype(np.float32)
            back = error[:, None] * net.out * (pooled > 0)
            hits, moves = [], []
            for k, f in enumerate(net.filters):
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                g = back[:, mine]
                df = np.empty_like(f)
                for j in range(len(f)):
                    at = where[:, mine] + j
                    inside = at < sizes[:, None]
                    words = rows[np.where(inside, begins[:, None] + at, 0)]
                    df[j] = np.einsum("tf,tfd->df", g, net.embed(words.reshape(-1, words.shape[2])).reshape(*at.shape, DIMENSIONS) * inside[:, :, None])
                    used = inside & (g != 0)
                    dx = (g[:, :, None] * f[j].T)[used] / rows.shape[1]
                    hits.append(words[used].ravel())
                    moves.append(np.repeat(dx, rows.shape[1], 0))
                step(f, filter_squares[k], df)
            step(net.out, out_square, pooled.T @ error)
            step(net.bias, bias_square, back.sum(0))
            step(net.shift, shift_square, error.sum(keepdims=True))
            hit, inverse = np.unique(np.concatenate(hits), return_inverse=True)
            move = np.concatenate(moves)
            dt = np.stack([np.bincount(inverse, move[:, d], len(hit)) for d in range(DIMENSIONS)], 1)
            step(net.table, squares[0], dt.astype(np.float32), hit)


def best_threshold(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit with the best F1 of those half-way between two texts."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], toxic[order], weight[order]
    caught, raised = np.cumsum(w * (y == 1)), np.cumsum(w)
    f1 = 2 * caught / (raised + (w * (y == 1)).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def added_up(rows: DataFrame, one: Callable[[list[dict]], np.ndarray]) -> np.ndarray:
    """The sum over all shards of the vector that ``one`` makes of a shard's rows; no task or driver holds more than a few.

    Rows of a shard come one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        each = (row for batch in batches for row in batch.to_pylist())
        for _, part in itertools.groupby(each, key=lambda row: row["shard"]):
            more = one(list(part))
            total = more if total is None else total + more
        for low in range(0, 0 if total is None else len(total), BLOCK):
            packed = pa.array([total[low : low + BLOCK].tobytes()], pa.binary())
            yield pa.record_batch([pa.array([low // BLOCK], pa.int32()), packed], names=["block", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in part["sums"].to_pylist())
        return pa.table([pa.array(part["block"].to_pylist()[:1], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])

    # The sums of an epoch are as large as all its networks.
    with shuffles_freed(rows.sparkSession):
        told = rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(told, key=lambda r: r.block)])


def taken_apart(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([x.size for x in like])
    return [flat[e - x.size : e].reshape(x.shape).astype(x.dtype) for e, x in zip(ends, like, strict=True)]


def _counted(known: DataFrame, names: list[str], all_shown: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shown texts by class and bucket, and words of all texts by bucket and language."""

    def one(rows: list[dict]) -> np.ndarray:
        met, said = np.zeros((2, BUCKETS)), np.zeros((BUCKETS, len(names)))
        for r in rows:
            words, _ = word_rows([r["text"].encode()])
            if all_shown or not r["held"]:
                met[r["toxic"], np.unique(words)] += 1
            if r["lang"] is not None:
                said[:, names.index(r["lang"])] += np.bincount(words[:, 0], minlength=BUCKETS)
        return np.concatenate([met.ravel(), said.ravel()])

    met, said = np.split(added_up(known, one), [2 * BUCKETS])
    return met.reshape(2, BUCKETS), said.reshape(BUCKETS, len(names))


def _epochs(known: DataFrame, net: Network, n: np.ndarray, shards: int) -> None:
    """Epochs over the texts of all shards; after each, the network is the mean of the shards' networks."""
    squares = [np.full_like(x, 1e-3) for x in net.parts()]
    weight = 0.5 * n.sum() / n
    # One shard has nobody to wait for.
    each = EPOCHS if shards == 1 else 1
    for begin in range(0, EPOCHS, each):
        sent = known.sparkSession.sparkContext.broadcast((begin, vars(net), squares))

        def one(rows: list[dict], sent: Broadcast = sent) -> np.ndarray:
            done, now, squares = sent.value
            net = Network(**{k: [x.copy() for x in v] if isinstance(v, list) else v if v is None else v.copy() for k, v in now.items()})
            squares = [x.copy() for x in squares]
            docs = [word_rows([r["text"].encode()])[0] for r in rows]
            fit(net, squares, docs, np.array([r["toxic"] for r in rows]), weight, done, each, 13 + rows[0]["shard"])
            return np.concatenate([[1.0], *(x.ravel().astype(float) for x in [*net.parts(), *squares])]) * len(rows)

        flat = added_up(known, one)
        parts = taken_apart(flat[1:] / flat[0], [*net.parts(), *squares])
        parts, squares = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        net.table, (net.bias, net.out, net.shift), net.filters = parts[0], parts[-3:], parts[1:-3]
        sent.destroy()
        release(known.sparkSession)


def _thresholds(kept: DataFrame, net: Network, exact: bool) -> np.ndarray:
    """The logit that parts both classes best, by language and for those without enough texts."""
    sent = kept.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**sent.value)
        for batch in batches:
            logits, languages = net.judged(byte_texts(batch["text"]))
            logits = logits if exact else np.floor(logits / GRID) * GRID
            yield pa.record_batch([batch["toxic"], pa.array(languages.astype(np.int32)), pa.array(logits)], names=["toxic", "language", "logit"])

    read = kept.select("text", "toxic").mapInArrow(run, "toxic int, language int, logit double")
    told = read.groupBy("toxic", "language", "logit").count().orderBy("language", "logit", "toxic").collect()
    logits, language, y, w = (np.array([r[c] for r in told]) for c in ("logit", "language", "toxic", "count"))
    n = net.languages.shape[1]
    out = np.full(n + 1, best_threshold(logits, y, w))
    for k in range(n):
        mine = language == k
        if w[mine & (y == 1)].sum() >= ENOUGH and w[mine & (y == 0)].sum() >= ENOUGH:
            out[k] = best_threshold(logits[mine], y[mine], w[mine])
    return out


def train(docs: DataFrame, labels: DataFrame, learnable: str) -> Network | float:
    """The network, fitted on documents that ``learnable`` selects; a constant score where a class is unknown."""
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.where(learnable).where("text IS NOT NULL")
    texts = texts.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    size = F.octet_length("text").alias("size")
    labelled = texts.select("doc_id", "h", size).join(known, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    labelled = durable(labelled)
    told = labelled.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    if len(told) < 2:
        return 1.0 if [r.toxic for r in told] == [1] else 0.0
    shards = max(1, -(-sum(r.size for r in told) // SHARD_BYTES))
    # Stored before they are dealt to shards: the shuffle of all texts is gone when that of the chosen ones begins.
    joined = durable(texts.join(labelled.drop("size"), ["doc_id", "h"]))
    turn = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long")
    chosen = joined.withColumns({"held": turn % 5 == 0, "shard": F.pmod("h", F.lit(shards)).cast("int")})
    # Each task writes whole shards to a file of their own, so no epoch shuffles texts.  Of equal rows the first stays.
    rows = chosen.repartition(shards, "shard").groupBy("doc_id", "h", "toxic", "held", "shard").agg(F.min(F.struct("text", "lang")).alias("d"))
    chosen = durable(rows.select("doc_id", "h", "toxic", "held", "shard", "d.*").sortWithinPartitions("shard", "h", "doc_id", "toxic"))
    del rows
    discard(joined)
    release(docs.sparkSession)

    counts = {(r.toxic, r.held): r["count"] for r in chosen.groupBy("toxic", "held").count().collect()}
    # Too few texts to keep some back are both learned from and judged.
    all_shown = len(counts) < 4
    shown, kept = (chosen, chosen) if all_shown else (chosen.where("NOT held"), chosen.where("held"))
    n = np.array([sum(c for (y, held), c in counts.items() if y == k and (all_shown or not held)) for k in (0, 1)])
    names = sorted(r.lang for r in chosen.select("lang").distinct().collect() if r.lang is not None) or [""]
    met, said = _counted(chosen, names, all_shown)
    net = Network.new(weights_of_evidence(met, n))
    _epochs(shown, net, n, shards)
    said = said + 0.1
    net.languages = np.log(said / said.sum(0)).astype(np.float32)
    net.languages -= net.languages.mean(1, keepdims=True)
    net.thresholds = _thresholds(kept, net, sum(counts.values()) <= EXACT)
    return net


def score(docs: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net if isinstance(net, float) else vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value if isinstance(sent.value, float) else Network(**sent.value)
        for batch in batches:
            texts = byte_texts(batch.column(1))
            scores = np.full(len(texts), net) if isinstance(net, float) else net.scores(texts)
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")
