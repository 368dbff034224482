"""Secret scanning: exact base patterns, and a character convolutional network over every further candidate.

``scan`` finds base spans and candidates (runs of 16 or more characters of the secret alphabet with a digit) with the
characters around them.  ``train`` fits the network in numpy on all distinct findings, labelled by whether a base pattern
holds them; in half of the examples the context is hidden, so the value itself must tell.  Findings are dealt to shards of
bounded size; in each epoch every shard takes its steps from the same network, and the shards' networks are averaged.
Scores are calibrated on counts of all held-out findings (Platt), and the threshold is the highest that keeps the recall
asked for there and the precision asked for as well; where none does, the network adds nothing.  ``judge`` scores all
candidates.

Null text is empty.  Rows are scanned one by one, so repeated rows get the same spans.  Only id and text are read.
An empty table gives an empty result, and a corpus without findings a network that adds nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import byte_texts
from chronoloom.session import durable

# The base patterns and their order.
KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
BEFORE, INSIDE, AFTER = 20, 44, 8
WIDTH = BEFORE + INSIDE + AFTER

#: Findings a shard of learning holds, about.
SHARD = 6000
EPOCHS = 12
#: Held-out scores are counted on a grid, so the driver sees at most so many steps either side of 0, of this size.
GRID, STEPS = 1 / 512, 1 << 15
RECALL, PRECISION = 0.95, 0.99

_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "=", ":", "\"'", " ", "_-", "./", "+@"]
N_CLASSES = len(_CLASSES) + 2
_CODE = np.full(128, N_CLASSES - 2, np.int64)
for _k, _s in enumerate(_CLASSES):
    _CODE[[ord(c) for c in _s]] = _k

FOUND = "array<struct<kind:string,begin:long,stop:long>>"
CANDIDATES = "array<struct<begin:long,stop:long,labelled:boolean,view:string>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base findings, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of hex digits is part of a run of the secret alphabet.
    for run in RUN.finditer(text):
        if run.end() - run.start() >= 32:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 32]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    out = []
    for run in RUN.finditer(text):
        value = run[0]
        if any(c.isdigit() for c in value):
            begin, stop = run.span()
            labelled = any(b < stop and begin < e for b, _, e in base)
            view = text[max(0, begin - BEFORE) : begin].rjust(BEFORE, "\0") + value[:INSIDE].ljust(INSIDE, "\0") + text[stop : stop + AFTER].ljust(AFTER, "\0")
            out.append({"begin": begin, "stop": stop, "labelled": labelled, "view": view})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base findings and candidates of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("stop", pa.int64())]))
        views = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("labelled", pa.bool_()), ("view", pa.string())]))
        for batch in batches:
            found, more = [], []
            for x in byte_texts(batch.column(1)):
                text = x.decode()
                base = base_spans(text)
                found.append([{"kind": KINDS[k], "begin": b, "stop": e} for b, k, e in base])
                more.append(candidates(text, base))
            yield pa.record_batch([batch.column(0), pa.array(found, kinds), pa.array(more, views)], names=["doc_id", "found", "candidates"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"doc_id long, found {FOUND}, candidates {CANDIDATES}")


def encode(views: list[str]) -> np.ndarray:
    """Character classes of views, one row each."""
    out = np.full((len(views), WIDTH), N_CLASSES - 1, np.int64)
    for i, v in enumerate(views):
        c = np.frombuffer(v.encode("utf-32-le"), "<u4")
        out[i, : len(c)] = np.where(c == 0, N_CLASSES - 1, _CODE[np.minimum(c, 127)])
    return out


#: What the steps of learning move, and the name of their moving means.
PARTS = ("table", "bias", "out", "shift")
Moves = dict[str, np.ndarray | float]


@dataclass
class Network:
    """Class embeddings, one convolution, the maximum over value and over context, and a logistic output."""

    table: np.ndarray  # width x class x filter: the convolution of one-hot classes
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = np.inf

    @classmethod
    def new(cls, filters: int = 12, width: int = 5, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (width, N_CLASSES, filters)), np.zeros(filters), rng.normal(0, 0.3, 2 * filters), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width, n = len(self.table), x.shape[1] - len(self.table) + 1
        z = self.bias + sum(self.table[j][x[:, j : j + n]] for j in range(width))
        inside = slice(BEFORE, BEFORE + INSIDE - width + 1)
        outside = z.copy()
        outside[:, inside] = -1e9
        best = np.stack([z[:, inside].argmax(1) + BEFORE, outside.argmax(1)], 1)  # row x part x filter
        top = np.take_along_axis(z[:, None], best[:, :, None], 2)[:, :, 0]
        pooled = np.maximum(top, 0).reshape(len(x), -1)
        return pooled @ self.out + self.shift, pooled, best

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, begin: int = 0, moves: Moves | None = None, rate: float = 0.02, batch: int = 128, seed: int = 7) -> Moves:
        """More epochs after the first ``begin``, going on from their moving means."""
        rng = np.random.default_rng(seed)
        names = PARTS
        moves = moves or {"step": 0.0} | {f"{kind} {n}": np.zeros_like(np.asarray(getattr(self, n), float)) for kind in ("moment", "square") for n in names}
        moment, square = ({n: moves[f"{kind} {n}"] for n in names} for kind in ("moment", "square"))
        step = moves["step"]
        for _ in range(begin):  # the draws of the epochs before
            rng.permutation(len(x))
            rng.random(len(x))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                rows = order[low : low + batch]
                xb = x[rows].copy()
                hidden = rng.random(len(rows)) < 0.5
                xb[hidden, :BEFORE] = N_CLASSES - 1
                xb[hidden, BEFORE + INSIDE :] = N_CLASSES - 1
                score, pooled, best = self.forward(xb)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) / len(rows)
                grad = {"out": pooled.T @ error, "shift": np.asarray(error.sum())}
                back = ((error[:, None] * self.out) * (pooled > 0)).reshape(best.shape)
                table = np.zeros_like(self.table)
                filters = np.broadcast_to(np.arange(best.shape[2]), best.shape)
                for j in range(len(self.table)):
                    kind = np.take_along_axis(xb, (best + j).reshape(len(rows), -1), 1).reshape(best.shape)
                    np.add.at(table[j], (kind, filters), back)
                grad |= {"table": table, "bias": back.sum((0, 1))}
                step += 1
                for n in names:
                    moment[n] = 0.9 * moment[n] + 0.1 * grad[n]
                    square[n] = 0.999 * square[n] + 0.001 * grad[n] ** 2
                    move = rate * (moment[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, getattr(self, n) - move)
        return {"step": step} | {f"moment {n}": moment[n] for n in names} | {f"square {n}": square[n] for n in names}

    def calibrate(self, score: np.ndarray, y: np.ndarray, count: np.ndarray, recall: float, precision: float) -> None:
        """Platt scaling on counted scores of held-out findings, then the threshold."""
        a, b = 1.0, 0.0
        weight = count / count.sum()
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
            a -= 0.1 * float((weight * (p - y) * score).sum())
            b -= 0.1 * float((weight * (p - y)).sum())
        self.scale, self.offset, self.threshold = a, b, np.inf
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        levels, at = np.unique(-p, return_inverse=True)
        caught = np.cumsum(np.bincount(at, count * (y == 1), len(levels)))
        taken = np.cumsum(np.bincount(at, count, len(levels)))
        k = int(np.argmax(caught >= recall * max(1, caught[-1])))
        if caught[k] >= max(recall * max(1, caught[-1]), precision * taken[k]):
            self.threshold = float(-levels[k])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(x)[0] + self.offset, -30, 30)))


def _rounds(known: DataFrame, net: Network, shards: int) -> None:
    """Epochs over the findings of all shards; after each, the network is the mean of the shards' networks."""
    spark = known.sparkSession
    moves: Moves | None = None
    # One shard has nobody to wait for.
    each = EPOCHS if shards == 1 else 1
    for begin in range(0, EPOCHS, each):
        sent = spark.sparkContext.broadcast((begin, vars(net), moves))

        def run(key: tuple, part: pa.Table) -> pa.Table:
            done, now, moves = sent.value
            net = Network(**{n: np.array(v) for n, v in now.items()})
            rows = sorted(part.to_pylist(), key=lambda r: (not r["labelled"], r["h"], r["view"].encode()))
            y = np.array([float(r["labelled"]) for r in rows])
            moves = moves and {n: np.array(v) for n, v in moves.items()}
            moves = net.fit(encode([r["view"] for r in rows]), y, each, done, moves, seed=7 + key[0].as_py())
            state = {n: len(rows) * v for n, v in moves.items()} | {n: len(rows) * getattr(net, n) for n in PARTS}
            return pa.table({"n": [len(rows)], "state": [pickle.dumps(state)]}, pa.schema([("n", pa.int64()), ("state", pa.binary())]))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, state = 0, None
            for batch in batches:
                for k, x in zip(batch["n"].to_pylist(), batch["state"].to_pylist(), strict=True):
                    more = pickle.loads(x)
                    n, state = n + k, more if state is None else {name: state[name] + more[name] for name in state}
            if n:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["n", "state"])

        # A task adds up its shards, so the driver sees one network a task.
        told = known.where("NOT held").groupBy("shard").applyInArrow(run, "n long, state binary").mapInArrow(add, "n long, state binary").collect()
        total = sum(r.n for r in told)
        states = [pickle.loads(r.state) for r in told]
        mean = {name: sum(x[name] for x in states) / total for name in states[0]}
        for name in PARTS:
            setattr(net, name, mean.pop(name))
        moves = mean


def train(scanned: DataFrame, recall: float = RECALL, precision: float = PRECISION) -> Network:
    """A network fitted on all distinct findings, and calibrated on those that the fit has not seen."""
    every = scanned.select(F.explode("candidates").alias("c")).select("c.labelled", "c.view").distinct()
    turn = F.conv(F.substring(F.md5("view"), 1, 2), 16, 10).cast("int")
    known = durable(every.select("labelled", "view", F.xxhash64("view").alias("h"), (turn % 4 == 0).alias("held")))
    counts = {(r.labelled, r.held): r["count"] for r in known.groupBy("labelled", "held").count().collect()}
    net = Network.new()
    if sum(counts.values()) < 20 or len({labelled for labelled, _ in counts}) < 2 or not any(not held for _, held in counts):
        return net
    shown = sum(n for (_, held), n in counts.items() if not held)
    shards = -(-shown // SHARD)
    _rounds(known.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")), net, shards)
    if len({labelled for labelled, held in counts if held}) == 2:
        sent = known.sparkSession.sparkContext.broadcast(vars(net))

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = Network(**sent.value)
            for batch in batches:
                if batch.num_rows:
                    score = net.forward(encode(batch["view"].to_pylist()))[0]
                    at = np.clip(np.floor(score / GRID), -STEPS, STEPS).astype(np.int32)
                    yield pa.record_batch([batch["labelled"], pa.array(at)], names=["labelled", "at"])

        held = known.where("held").select("labelled", "view").mapInArrow(scores, "labelled boolean, at int")
        told = held.groupBy("labelled", "at").count().orderBy("at", "labelled").collect()
        net.calibrate(*(np.array([float(r[c]) for r in told]) * f for c, f in (("at", GRID), ("labelled", 1.0), ("count", 1.0))), recall, precision)
    return net


def judge(scanned: DataFrame, net: Network) -> DataFrame:
    """All spans of every document: base findings, and candidates that no base finding holds and the network takes."""
    sent = scanned.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**sent.value)
        for batch in batches:
            found, more = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            open_ = [(i, c) for i, cs in enumerate(more) for c in cs if not c["labelled"]]
            for low in range(0, len(open_), 2048):
                some = open_[low : low + 2048]
                p = net.probability(encode([c["view"] for _, c in some]))
                for (i, c), score in zip(some, p, strict=True):
                    if score >= net.threshold:
                        found[i].append({"kind": "net", "begin": c["begin"], "stop": c["stop"]})
            found = [sorted(f, key=lambda s: (s["begin"], KINDS.index(s["kind"]))) for f in found]
            yield pa.record_batch([batch.column(0), pa.array(found, batch.column(1).type)], names=["doc_id", "spans"])

    return scanned.mapInArrow(run, f"doc_id long, spans {FOUND}")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every document, from one pass over the texts."""
    scanned = durable(scan(docs))
    return judge(scanned, train(scanned))


def mask(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each covered stretch replaced by a mark."""
    out, at = [], 0
    for begin, stop in sorted(spans):
        if stop <= at:
            continue
        if begin >= at:
            out += [text[at:begin], mark]
        at = stop
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, net: Network, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with every span masked; all columns stay, and a masked row's ``size_col`` counts its new text."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(net))
    names, at = docs.columns, docs.columns.index(text_col)
    size_at = names.index(size_col) if size_col in names and docs.schema[size_col].dataType.typeName() == "long" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size_at).to_pylist() if size_at is not None else None
            for i, text in enumerate(texts):
                if text is None:
                    continue
                base = base_spans(text)
                spans = [(b, e) for b, _, e in base]
                open_ = [c for c in candidates(text, base) if not c["labelled"]]
                if open_:
                    p = net.probability(encode([c["view"] for c in open_]))
                    spans += [(c["begin"], c["stop"]) for c, score in zip(open_, p, strict=True) if score >= net.threshold]
                if spans:
                    texts[i] = mask(text, spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
