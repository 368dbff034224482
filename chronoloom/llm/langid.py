"""Language identification with error-correcting output codes.

Every language has a codeword; one linear classifier over hashed byte n-grams (of one to three bytes) predicts each bit.
Decoding weighs each bit's logistic loss by the bit's held-in accuracy and takes the nearest codeword; a text whose two
nearest codewords are close together is flagged as ambiguous.

Null text or a text without a letter is ``und`` with score 0.  Whole texts are read.  Rows are judged one by one, so
repeated rows get equal answers.  Rows without a language are not learned from; with no labelled row at all every text
is ``und``.  Only id, text and (for learning) language are read; other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import LOWER, byte_texts

FEATURES = 1 << 14
#: Learning reads at most so many rows of each language, first in hash order, and texts up to so many bytes.
SAMPLE, SAMPLE_BYTES = 300, 20_000
EPOCHS = 60


def features(text: bytes) -> np.ndarray:
    """Frequencies of hashed byte n-grams; a long text is counted in pieces."""
    total = np.zeros(FEATURES, np.float64)
    piece = 1 << 20
    for low in range(0, len(text), piece):
        b = LOWER[np.frombuffer(text[max(0, low - 2) : low + piece], np.uint8)].astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        for k, codes in ((1, b), (2, two), (3, three)):
            h = ((codes + np.uint32(k * 77777)) * np.uint32(2654435761)) >> np.uint32(18)
            total += np.bincount(h, minlength=FEATURES)
    n = total.sum()
    # Square roots of frequencies have unit length, so long and short texts compare.
    return np.sqrt(total / n) if n else total


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of at least 15 bits, random columns with distinct splits, far apart."""
    rng = np.random.default_rng(seed)
    bits = max(15, 4 * int(np.ceil(np.log2(max(n, 2)))))
    if n <= 4:
        # All splits of the languages in two, repeated up to the length: an exhaustive code.
        splits = [[(s >> i) & 1 for i in range(n)] for s in range(1, max(2, 1 << (n - 1)))]
        return np.array([splits[k % len(splits)] for k in range(bits)]).T
    best, distance = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (n, bits))
        code[:, code.sum(0) % n == 0] ^= (np.arange(n) % 2)[:, None]
        gap = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if gap > distance:
            best, distance = code, gap
    return best


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether the two nearest codewords are close, for rows of features."""
        margin = x @ self.weights + self.bias
        sign = 2 * self.code - 1
        loss = np.logaddexp(0, -margin[:, None, :] * sign[None]) @ self.trust
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        return best, score, score < 0.6


def learn(rows: list[tuple[bytes, str]]) -> Codebook | None:
    """Bit classifiers by full-batch gradient descent with momentum; each bit sees a random half of the features."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    code = codewords(len(languages))
    x = np.array([features(t) for t, _ in rows])
    y = code[[languages.index(lang) for _, lang in rows]].astype(float)
    rng = np.random.default_rng(5)
    shown = rng.random((FEATURES, code.shape[1])) < 0.5
    weights, bias = np.zeros((FEATURES, code.shape[1])), np.zeros(code.shape[1])
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        error = (p - y) / len(x)
        speed_w = 0.9 * speed_w - 20.0 * (x.T @ error + 1e-6 * weights) * shown
        speed_b = 0.9 * speed_b - 1.0 * error.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    right = ((x @ weights + bias > 0) == (y > 0.5)).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return Codebook(languages, code, weights, bias, trust / trust.mean())


def train(docs: DataFrame, learnable: str, sample: int = SAMPLE) -> Codebook | None:
    """Fits on at most ``sample`` rows of each language among those that ``learnable`` selects."""
    rows = docs.where(learnable).where("lang IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    languages = [r.lang for r in rows.select("lang").distinct().collect()]
    picked = []
    for lang in sorted(languages):
        first = rows.where(F.col("lang") == lang).select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h", "text").limit(sample)
        picked += [(r.text.encode(), lang) for r in first.collect()]
    return learn(picked)


def predict(docs: DataFrame, book: Codebook | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, score and ambiguity of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(book and vars(book))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(**sent.value) if sent.value else None
        for batch in batches:
            texts = byte_texts(batch.column(1))
            named = ["und"] * len(texts)
            scores, unsure = np.zeros(len(texts)), np.ones(len(texts), bool)
            lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t.decode()))] if book else []
            for low in range(0, len(lettered), 64):
                some = lettered[low : low + 64]
                best, score, close = book.decode(np.array([features(texts[i]) for i in some]))
                scores[some], unsure[some] = score, close
                for i, k in zip(some, best.tolist(), strict=True):
                    named[i] = book.languages[k]
            yield pa.record_batch(
                [batch.column(0), pa.array(named), pa.array(scores), pa.array(unsure)],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
