"""The trie of conversation prefixes against a plain version, long and repeated conversations included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import queries, tries


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, h), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(family, [])[:h] + ts[h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    out = []
    for p, cs in members.items():
        ids = ",".join(map(str, sorted(c for c in cs if len(rebuilt[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    pool = [(rng.choice(["user", "assistant", None]), " ".join("word" for _ in range(rng.randint(0, 6)))) for _ in range(5)]
    rows = []
    for c in range(-45, 130):
        if c % 7 == 3:
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn * 3 - 2, *rng.choice(pool)))
    rows += [(5, None, "user", "before all"), (5, None, "user", "before all"), (5, 1, None, None), (5, 1, "user", "")]
    rows += [(None, 0, "user", "nobody's"), (1001, 0, "user", "alone"), (4021, 9, "user", "é ß\x00 \x0b汉字 x"), (4022, 9, "u", "long " * 50_000)]
    # Long conversations: one of its own, and two that share nearly all.
    rows += [(5000, i, "user", f"turn {i % 17}") for i in range(900)]
    rows += [(c, i, "user", f"turn {i % 11}") for c in (6000, 6001) for i in range(400 + c % 2)]
    # Each continues the one before, so that owners change at every depth.
    rows += [(7000 + 20 * c, i, "user", f"step {i}") for c in range(25) for i in range(c + 1)]
    # Copies beyond a shard's members.
    rows += [(10_000 + c, i, "user", f"same {i}") for c in range(60) for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [4, 512])
def test_nodes(spark, folder, most):
    rows = conversations(most)
    at = folder(extra=True, conversations=rows)
    got = tries.prefix_nodes(spark.read.parquet(f"{at}/conversations.parquet").repartition(7), most).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_query_and_empty_table(spark, folder):
    rows = conversations(1)[:400]
    got = queries.op12_conversation_prefix_trie(spark, folder(conversations=rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert queries.op12_conversation_prefix_trie(spark, folder()).count() == 0


def test_one_row_many_times(spark):
    df = spark.range(20_000).select(F.lit(40).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a b").alias("text"))
    got = tries.prefix_nodes(df.repartition(5))
    found = got.agg(F.count("*"), F.max("depth"), F.max("n_convs"), F.sum("n_leaves"), F.max("saved_tokens")).first()
    assert tuple(found) == (20_001, 20_000, 1, 20_001, 0)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (5000, 3)).astype(np.uint64)
    slots = tries.Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(5000))
    assert (slots.find(keys + np.uint64(1)) == -1).all()
    assert tries.Slots(keys[:0]).find(keys).tolist() == [-1] * 5000
