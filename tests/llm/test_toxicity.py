"""Learning from every labelled text, whole and in shards."""

from __future__ import annotations

import numpy as np

from chronoloom.llm import toxicity


def labelled(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghinorst"), 6)) for _ in range(60)]
    return [(i, " ".join([*rng.choice(words, 30), *(["vilewretch"] if i % 3 == 0 else [])]), "en", int(i % 3 == 0)) for i in range(n)]


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_shards_learn_from_every_text(spark, monkeypatch):
    rows = labelled()
    docs, labels = frames(spark, rows)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 16_000)
    counted = []
    monkeypatch.setattr(toxicity, "weights_of_evidence", lambda met, n, f=toxicity.weights_of_evidence: (counted.append((met, n)), f(met, n))[1])
    judged = []
    monkeypatch.setattr(toxicity, "best_threshold", lambda z, y, w, f=toxicity.best_threshold: (judged.append(w.sum()), f(z, y, w))[1])
    net = toxicity.train(docs, labels, "true")
    assert counted[0][1].sum() + judged[0] == len(rows)
    assert counted[0][0][1, toxicity.word_rows([b"vilewretch"])[0][0, 0]] == counted[0][1][1]
    got = toxicity.score(docs, net).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.97


def test_long_texts_are_learned_from(spark):
    """The word that tells stands behind more than 20,000 bytes of others."""
    rows = [(i, "plain words here " * 1300 + t, lang, y) for i, t, lang, y in labelled(60)]
    docs, labels = frames(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, labels, "true")).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.9


def test_summits_do_not_depend_on_pieces(monkeypatch):
    net = toxicity.Network.new(np.zeros(toxicity.BUCKETS, np.float32))
    words, _ = toxicity.word_rows([" ".join(t for _, t, _, _ in labelled(5)).encode()])
    whole = net.summits(words)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 7)
    for a, b in zip(whole, net.summits(words), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-5)


def test_shuffle_files_are_released_after_every_epoch(spark, monkeypatch):
    docs, labels = frames(spark, labelled())
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 16_000)
    released = []
    monkeypatch.setattr(toxicity, "release", lambda s, f=toxicity.release: (released.append(s), f(s)))
    toxicity.train(docs, labels, "true")
    assert len(released) == toxicity.EPOCHS + 1


def test_stored_frames_and_sums_leave_no_shuffle_files(spark):
    """Without a garbage collector: the files are gone soon after the frame is written or the sums are made."""
    import time
    from pathlib import Path

    from pyspark.sql import functions as F

    from chronoloom.session import durable

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def left():
        return {f for at in folders for f in Path(at).rglob("shuffle_*.data")}

    before = left()
    stored = durable(spark.range(5000).withColumn("shard", F.lit(0)).repartition(3, "id").groupBy("id", "shard").count())
    toxicity.added_up(stored, lambda rows: np.ones(3))
    for _ in range(50):
        if left() <= before:
            return
        time.sleep(0.1)
    assert not left() - before
