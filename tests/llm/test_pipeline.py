"""The pipeline stage by stage against plain versions, and its queries against their SQL."""

from __future__ import annotations

import random

import brute
import pytest
from compare import difference, duck

import __spark_entry__ as entry
import corpus_pipeline
from chronoloom.llm import queries, secrets
from chronoloom.llm.sql import SQL


def documents():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    item, base = prose(25), prose(80)
    rows = [(i, prose(rng.randint(12, 90)), "en", "s", None) for i in range(30)]
    rows += [(40, base, "en", "s", None), (41, base, "en", "s", None), (42, base + " more", "en", "s", None), (43, "short", "en", "s", 5), (44, None, None, None, None)]
    rows += [(45, prose(20) + " " + item + " " + prose(20), "en", "s", None), (46, prose(30) + ' token = "' + "0a" * 20 + '" ' + prose(20), "en", "s", 99)]
    rows += [(47, "| " * 60, "en", "s", None), (None, prose(40), "en", "s", None), (48, prose(9000), "en", "s", None)]
    return rows, [(1, item), (2, None)]


def test_stages(spark, folder):
    docs, items = documents()
    at = folder(extra=True, documents=docs, benchmark=items)
    frame = spark.read.parquet(f"{at}/documents.parquet")
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.collect()
        out = stage(spark, frame, at)
        path = f"{at}/stage{k}"
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        after = frame.collect()
        if k < 4:
            assert frame.columns == columns, name
        texts = {r.doc_id: r.text for r in before}
        ids = {r.doc_id for r in after}
        if k == 0:
            kept = {i for i, t in texts.items() if not brute.quality(t)[5] and not (t and t.startswith("|"))}
            assert ids == kept
        if k == 1:
            groups = brute.components([(i, t) for i, t in texts.items() if i is not None])
            assert ids == {i for i, (_, c) in groups.items() if i == c} | {None}
            assert 41 not in ids and 42 not in ids and 40 in ids
        if k == 2:
            hit = brute.contamination([(i, t) for i, t in texts.items()], items)
            assert ids == {i for i, h in hit.items() if not h[4]} and 45 not in ids
        if k == 3:
            assert ids == set(texts)
            for r in after:
                spans = [(b, e) for b, _, e in brute.secret_spans(texts[r.doc_id])]
                assert r.text == secrets.mask(texts[r.doc_id], spans)
                assert not spans or r.n_chars == len(r.text)
        if k == 4:
            assert ids == set(texts)


def test_contaminated_rows_without_an_id_or_with_a_shared_one(spark, folder):
    item = " ".join(f"item{i}" for i in range(12))
    at = folder(documents=[(None, "x " + item), (None, "clean"), (3, item + " y"), (3, "clean too")], benchmark=[(1, item)])
    out = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("3", "clean too"), ("None", "clean")]


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder()).count() == 0


def test_rows_that_share_an_id(spark, folder):
    at = folder(documents=[(1, "a b c d e f g h"), (1, "z y x w v u t s"), (2, "a b c d e f g h")])
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "a b c d e f g h")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert difference(got, duck(small).execute(SQL[name]).fetchdf()) is None


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(SQL) <= set(entry.oracle_sql())
