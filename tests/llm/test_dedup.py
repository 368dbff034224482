"""Substring dedup, the n-gram join and decontamination against plain versions, edge cases included."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from tables import rows

from chronoloom import session
from chronoloom.llm import jaccard, postings, queries, substrings
from chronoloom.llm.components import components


def texts(seed=3, n=60):
    """Copies, near copies, shared passages, repeated words, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def prose(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, base = prose(60), prose(120)
    out = [None, "", " \n\t", "one", "ONE", "one two three four", "One two three Four"]
    for i in range(n):
        w = prose(rng.randint(5, 150))
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randint(0, 30) :]
        if i % 4 == 1:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(rng.choice([" ", "\n", "\x0b "]).join(w))
    out += [out[-1], out[-2], "again " * 400, "again " * 90, " ".join(prose(9000))]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs():
    return texts()


@pytest.fixture(scope="module")
def items(docs):
    long = docs[-1][1].split()
    return [(1, " ".join(long[100:130])), (2, "One, two; THREE"), (3, None), (4, "..."), (5, " ".join(long[500:504])), (6, " ".join(long[100:130])), (11, "again " * 12)]


@pytest.fixture(scope="module")
def tables(folder, docs, items):
    return folder(extra=True, documents=docs, benchmark=items)


def test_substrings(spark, tables, docs):
    got = rows(queries.op1_substring_dedup(spark, tables))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.substrings(docs)


def test_substrings_with_every_representative_hot(spark, tables, docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "SHARD", 5)
    got = rows(queries.op1_substring_dedup(spark, tables))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.substrings(docs)


def test_components_of_similar_documents(spark, tables, docs):
    got = rows(queries.op5_ngram_jaccard_join(spark, tables))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.components(docs)


def test_components_with_groups_cut_into_blocks(spark, tables, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", 300)
    got = rows(queries.op5_ngram_jaccard_join(spark, tables))
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in brute.components(docs).items()}


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_components_with_groups_cut_into_strips(spark, tables, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "LARGE_GROUP", 2)
    monkeypatch.setattr(jaccard, "BLOCK_HASHES", block)
    got = rows(queries.op5_ngram_jaccard_join(spark, tables))
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in brute.components(docs).items()}


def test_sets_that_share_common_lines_only_are_not_searched(monkeypatch):
    rng = np.random.default_rng(5)
    lines = np.split(rng.choice(10**6, 40, replace=False).astype(np.uint64), 4)
    sets = []
    for k in range(120):
        picked = [lines[x] for x in rng.permutation(4)[:2]]
        sets.append(np.unique(np.concatenate([*picked, rng.integers(10**6, 10**9, 8 + k % 20).astype(np.uint64)])))
    sets += [np.unique(np.append(sets[k], np.uint64(10**9 + k))) for k in range(3)]
    added, add = [], jaccard.Trie.add

    def counted(self, path, member):
        added.append(member)
        return add(self, path, member)

    monkeypatch.setattr(jaccard.Trie, "add", counted)
    assert sorted(jaccard.spanning_links(sets, list(range(123)))) == [(0, 120), (1, 121), (2, 122)]
    assert len(added) < 20


def test_contamination(spark, tables, docs, items):
    got = rows(queries.op3_benchmark_decontamination(spark, tables))
    want = brute.contamination(docs, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert any(w[4] for w in want.values())


def test_contamination_in_blocks_and_small_segments(spark, tables, docs, items, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_WORDS", 40)
    monkeypatch.setattr(postings, "SEGMENT_WORDS", 500)
    got = rows(queries.op3_benchmark_decontamination(spark, tables))
    assert {i: (r.n_words, r.n_hit, r.n_items) for i, r in got.items()} == {i: w[:3] for i, w in brute.contamination(docs, items).items()}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a z z z z z z z b c"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    found = rows(postings.search(postings.build_index(docs), items, slop=5))
    assert {i: r["items"] for i, r in found.items()} == {1: [7], 2: [7], 3: [], 4: []}
    assert {i: r["items"] for i, r in rows(postings.search(postings.build_index(docs), items)).items()} == {1: [], 2: [], 3: [], 4: []}


def test_proximity_equals_every_window(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 60))) for _ in range(40)]
    texts.append("x " * 8 + "b x a x x b c")
    items = [(k, " ".join(rng.choices("abcdefg", k=rng.randint(1, 5)))) for k in range(12)] + [(50, "a b c"), (51, "a a b"), (52, "a q")]
    slop = 6
    want = {}
    for i, text in enumerate(texts):
        w = text.split()
        hit, held = set(), set()
        for item, phrase in items:
            need = Counter(phrase.split())
            for e in range(len(w)):
                starts = [s for s in range(max(0, e - slop + 1), e + 1) if not need - Counter(w[s : e + 1])]
                if starts and w[e] in need:
                    held.add(item)
                    hit.update(range(starts[-1], e + 1))
        want[i] = (len(hit), sorted(held))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(postings.search(postings.build_index(docs), spark.createDataFrame(items, "item_id long, text string"), slop=slop))
    assert {i: (r.n_hit, sorted(r["items"])) for i, r in found.items()} == want


def test_term_bits_set_the_bit_of_every_word(spark):
    bits = postings.term_bits(spark.createDataFrame([(" ".join(f"w{k}" for k in range(500)),), (None,)], "text string"))
    assert len(bits) * 8 == postings.TERM_BITS
    places = [zlib.crc32(f"w{k}".encode()) % postings.TERM_BITS for k in range(500)]
    assert all(bits[p >> 3] >> (p & 7) & 1 for p in places) and sum(b.bit_count() for b in bits) == len(set(places))


def test_rows_of_one_id_lose_only_their_own_words(spark, folder):
    p, q = (" ".join(f"{x}{i}" for i in range(40)) for x in "pq")
    got = queries.op1_substring_dedup(spark, folder(documents=[(1, p), (5, p + " end"), (5, q), (5, q)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 40, 0), (5, 40, 0), (5, 40, 0), (5, 41, 40)]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_benchmark_decontamination", "op5_ngram_jaccard_join"])
def test_empty_and_null(spark, folder, name):
    assert queries.QUERIES[name](spark, folder()).count() == 0
    text = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21"
    # Rows without an id, and equal rows, are each answered.
    got = queries.QUERIES[name](spark, folder(documents=[(None, text), (1, text), (1, text), (2, None)], benchmark=[(None, text)])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    if name.startswith("op1"):
        assert all(r.n_removed == 0 for r in got)
    if name.startswith("op5"):
        assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1), (2, 2)}


def test_zero_bytes_are_part_of_words(spark, folder):
    got = rows(queries.op5_ngram_jaccard_join(spark, folder(documents=[(1, "a a\0 b c d"), (2, "a a b c d"), (3, "a a\0 b c d")])))
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 2, 3: 1}


def test_rows_of_one_id_are_one_node(spark, folder):
    p, q, s = (" ".join(f"{x}{i}" for i in range(60)) for x in "pqs")
    docs = [(1, p), (5, p), (5, q), (7, q), (8, q + " end"), (9, s), (9, "short one"), (10, s + " end"), (11, "short one")]
    got = queries.op5_ngram_jaccard_join(spark, folder(documents=docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (7, 1), (8, 1), (9, 9), (9, 9), (10, 9), (11, 9)]


def test_one_of_each_with_clashing_names(spark, folder):
    at = folder(extra=True, documents=[(1, "a b c d e f"), (1, "z y x w v u"), (2, "a b c d e f"), (None, "q")])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a b c d e f"), ("None", "q")]


def test_frames_of_hashes_are_deleted_once_read(spark, docs):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"))
    left = [spark.read.parquet(f"{folder}/{f}").columns for f in set(os.listdir(folder)) - before]
    assert left and not [c for c in left if {"firsts", "hashes", "h"} & set(c)]
    assert found.count() == len(docs)


def test_component_names(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 7), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pool = rng.choice(400, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(40):
            s = rng.choice(pool, rng.integers(1, 60), replace=False) if rng.random() < 0.3 else rng.permutation(pool)[: rng.integers(45, 60)]
            sets.append(np.unique(s))
        want, got = Forest(40), Forest(40)
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    want.join(i, j)
        for i, j in jaccard.spanning_links(sets, list(range(40))):
            got.join(i, j)
        assert [want.root(i) for i in range(40)] == [got.root(i) for i in range(40)]


def test_trie_links_without_pairs_of_guests_and_in_small_batches(monkeypatch):
    monkeypatch.setattr(jaccard, "PROBE_ASKED", 20)
    monkeypatch.setattr(jaccard, "PROBE_STEPS", 50)
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = np.random.default_rng(2)
    for _ in range(20):
        pool = np.sort(rng.choice(400, 60, replace=False).astype(np.uint64))
        sets = [np.sort(rng.permutation(pool)[: rng.integers(48, 60)]) for _ in range(50)]
        guest, block = (rng.random(50) < 0.5).tolist(), rng.integers(0, 2, 50).tolist()
        keys = [[int(h) for h in s[:4]] for s in sets]
        want, got = Forest(50), Forest(50)
        for i in range(50):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                meet = set(keys[i]) & set(keys[j]) and block[i] != block[j] and not (guest[i] and guest[j])
                if meet and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    want.join(i, j)
        for i, j in jaccard.spanning_links(sets, list(range(50)), keys, block, guest):
            got.join(i, j)
        assert [want.root(i) for i in range(50)] == [got.root(i) for i in range(50)]


def test_probes_go_down_the_trie_together(monkeypatch):
    rng = np.random.default_rng(3)
    pool = np.sort(rng.choice(10**9, 300, replace=False).astype(np.uint64))
    sets = [pool[rng.random(300) > 0.04] for _ in range(400)]
    calls, ranges = [], jaccard._ranges

    def counted(begin, end):
        calls.append(len(begin))
        return ranges(begin, end)

    monkeypatch.setattr(jaccard, "_ranges", counted)
    assert len(jaccard.spanning_links(sets, list(range(400)))) == 399
    assert len(calls) < 20_000


def test_one_of_each_joins_the_few_ids_that_leave(spark):
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}") for i in range(4000)]
    rows += [(9000, rows[7][1]), (9001, rows[8][1]), (None, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6k")
    try:
        out = jaccard.one_of_each(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == list(range(4000))
        assert out.where("doc_id IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
