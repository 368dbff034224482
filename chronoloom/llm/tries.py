"""The trie of conversation prefixes: members, children, leaves and tokens saved below every shared prefix.

**Digests.** Two 64-bit lanes of each turn's SHA-256 are summed along the conversation, each times a power of an odd
constant.  Such sums can be shifted and joined, so a conversation may lie on any number of tasks: turns are sorted by
range, every task sums its own stretches, and one row per stretch says how to continue.  Rows that meet at a digest
must agree in turn and parent, or the job fails.

**Nodes.** Every member of a prefix adds to that prefix's row, merged before the shuffle.  The smallest member owns a
node; the nodes of one owner with equally many members are a *run*, a path without branch or end, and all sums inside
it follow from running word counts.  There are at most two runs for each conversation, however long it is.

**Shards.** Runs with at most ``SHARD_MEMBERS`` members are dealt by the first prefix on their path that has no more.
In a shard a minimal perfect hash gives every run's last digest a slot of its own; the digest stored there is compared,
so a parent outside the shard is told apart.  Counts are scattered into flat arrays by slot and added to the parents'
slots from the deepest level to the top.  What a shard has below a parent elsewhere is carried to the next tier, runs
with at most ``SHARD_MEMBERS`` times more members, and so on up to the root; a tier has that many times fewer runs.

Null roles and texts are empty; a null turn number comes first, and turns of one number go by the SHA-256 of role and
text, so repeated rows are repeated turns.  Rows without a conversation are left out.  Texts may have any length; they
are hashed where they are read and never shuffled.  An empty table has no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import mix
from chronoloom.session import durable

SHARD_MEMBERS, SHARD_RUNS = 512, 2048
SHARED_TURNS, FAMILY = 4, 20
#: Bytes of ids that are hashed together.
ID_BYTES = 1 << 14

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_ALL = (1 << 64) - 1
KEY = ["depth", "da", "db"]


def power(k: np.ndarray) -> np.ndarray:
    """BASE to the k, modulo 2**64, by squaring."""
    out, square = np.ones(len(k), np.uint64), np.full(1, BASE, np.uint64)
    for bit in range(int(k.max(initial=0)).bit_length()):
        out = np.where(k >> bit & 1 == 1, out * square, out)
        square = square * square
    return out


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _int64(x: int) -> int:
    x &= _ALL
    return x - (1 << 64) if x >> 63 else x


# ---- turns in order, with running sums inside each task's stretch of a conversation


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """``part, conv_id, r, ta, tb, pa, pb, words, total``: place in the stretch, the turn's lanes, and sums up to here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("h"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("place"),
    )
    # Place parts equal rows, however many there are.
    order = ["conv_id", F.asc_nulls_first("turn"), "h", "place"]
    ranged = durable(turns).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r0, sums = None, 0, np.zeros(3, np.uint64)
        for batch in batches:
            conv = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            lanes = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").reshape(-1, 4)[:, :2].astype(np.uint64)
            words = unsigned(batch.column(3))
            new = np.r_[True, conv[1:] != conv[:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            r = np.arange(len(conv)) - first + 1
            if conv[0] == now:
                r[first == 0] += r0
            p = power(r)
            running = np.cumsum(np.stack([lanes[:, 0] * p, lanes[:, 1] * p, words], 1), 0, dtype=np.uint64)
            before = np.where((first > 0)[:, None], running[first - 1], 0 if conv[0] != now else -sums)
            running = running - before.astype(np.uint64)
            now, r0, sums = conv[-1], r[-1], running[-1]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(r), *(signed(x.copy()) for x in (lanes[:, 0], lanes[:, 1])),
                 *(signed(x.copy()) for x in running.T[:2]), batch.column(3), signed(running[:, 2].copy())],
                names=["part", "conv_id", "r", "ta", "tb", "pa", "pb", "words", "total"],
            )

    columns = ranged.select(F.spark_partition_id().alias("part"), "conv_id", "h", "words")
    schema = "part int, conv_id long, r long, ta long, tb long, pa long, pb long, words long, total long"
    return durable(columns.mapInArrow(run, schema))


# ---- rebuilt conversations: how each stretch continues, and the turns taken over


STRETCH = "struct<part:int,shift:long,skip:long,xa:long,xb:long,ya:long,yb:long,words:long,last:long>"
MEMBER = "depth:long,da:long,db:long,pa:long,pb:long,ta:long,tb:long,words:long,total:long,ends:boolean"


def continued(c: int, stretches: list[dict], own: list[dict], base: list[dict]) -> tuple[list[dict], list[dict]]:
    """For each stretch the linear map from its sums to those of the rebuilt conversation, and the first members."""
    h = zlib.crc32(str(c).encode()) % SHARED_TURNS
    head = base[:h]
    total = sum(s["r"] for s in stretches)
    last = len(head) + max(total - h, 0)
    heads = [dict(depth=0, da=0, db=0, pa=0, pb=0, ta=0, tb=0, words=0, total=0, ends=last == 0)]
    a = b = words = 0
    for d, t in enumerate(head, 1):
        p, up = pow(BASE, d, 1 << 64), (a, b)
        a, b, words = a + t["ta"] * p, b + t["tb"] * p, words + t["words"]
        heads.append(dict(depth=d, da=_int64(a), db=_int64(b), pa=_int64(up[0]), pb=_int64(up[1]), ta=t["ta"], tb=t["tb"],
                          words=t["words"], total=words, ends=d == last))
    skipped = own[:h]
    gone = [sum(t[k] * pow(BASE, i, 1 << 64) for i, t in enumerate(skipped, 1)) for k in ("ta", "tb")]
    gone_words = sum(t["words"] for t in skipped)
    back = pow(_INVERSE, h - len(head), 1 << 64)
    out, start, sum_a, sum_b, sum_words = [], 0, 0, 0, 0
    for s in stretches:
        scale = pow(BASE, start, 1 << 64)
        if start + s["r"] > h:
            out.append(dict(part=s["part"], shift=start + len(head) - h, skip=h - start,
                            xa=_int64(a + back * (sum_a - gone[0])), xb=_int64(b + back * (sum_b - gone[1])),
                            ya=_int64(back * scale), yb=_int64(back * scale), words=words + sum_words - gone_words, last=last))
        start, sum_a, sum_b = start + s["r"], sum_a + scale * s["pa"], sum_b + scale * s["pb"]
        sum_words += s["total"]
    return out, heads


def members(conversations: DataFrame) -> DataFrame:
    """One row for each rebuilt conversation and each of its prefixes, the empty one included."""
    turns = sorted_turns(conversations)
    ends = turns.groupBy("part", "conv_id").agg(F.max("r").alias("r"), *(F.max_by(c, "r").alias(c) for c in ("pa", "pb", "total")))
    # A conversation has at most as many stretches as there are partitions.
    whole = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "r", "pa", "pb", "total"))).alias("stretches"))
    # Its first turns are among the first of each stretch; at most three of each travel, and three are kept.
    first = turns.where(F.col("r") < SHARED_TURNS).groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("part", "r", "ta", "tb", "words"))).alias("t")
    )
    first = first.groupBy("conv_id").agg(F.slice(F.flatten(F.sort_array(F.collect_list("t"))), 1, SHARED_TURNS - 1).alias("own"))
    own = durable(whole.join(first, "conv_id"))
    base = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("own").alias("base"))
    both = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "family", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("stretches", pa.list_(_struct(STRETCH))), ("heads", pa.list_(_struct(f"struct<{MEMBER}>")))])
        for batch in batches:
            rows = [(c, *continued(c, s, o, b or [])) for c, s, o, b in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(conv_id=c, stretches=s, heads=h) for c, s, h in rows], schema)

    rebuilt = durable(
        both.select("conv_id", "stretches", "own", "base").mapInArrow(run, f"conv_id long, stretches array<{STRETCH}>, heads array<struct<{MEMBER}>>")
    )
    stretches = rebuilt.select("conv_id", F.explode("stretches").alias("s")).select(
        "conv_id", "s.part", "s.shift", "s.skip", "s.xa", "s.xb", "s.ya", "s.yb", F.col("s.words").alias("before"), "s.last"
    )
    # Both sides are small for one key: a stretch lies in one task's range.
    joined = turns.join(stretches, ["part", "conv_id"]).where(F.col("r") > F.col("skip"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: unsigned(batch.column(n)) for n in batch.schema.names}
            depth = (c["r"] + c["shift"]).view(np.int64)
            p = power(depth)
            da, db = c["xa"] + c["ya"] * c["pa"], c["xb"] + c["yb"] * c["pb"]
            yield pa.record_batch(
                [batch.column("conv_id"), pa.array(depth), signed(da), signed(db), signed(da - c["ta"] * p), signed(db - c["tb"] * p),
                 batch.column("ta"), batch.column("tb"), batch.column("words"), signed(c["total"] + c["before"]),
                 pa.array(depth == c["last"].view(np.int64))],
                names=["conv_id", *(f.split(":")[0] for f in MEMBER.split(","))],
            )

    own_rows = joined.select(
        "conv_id", "r", "ta", "tb", "pa", "pb", "words", "total", "shift", "xa", "xb", "ya", "yb", "before", "last"
    ).mapInArrow(place, "conv_id long, " + MEMBER.replace(":", " ").replace(",", ", "))
    return durable(own_rows.unionByName(rebuilt.select("conv_id", F.inline("heads"))))


def _struct(ddl: str) -> pa.DataType:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.struct([(n, kinds[k]) for n, k in (f.split(":") for f in ddl[len("struct<") : -1].split(","))])


# ---- nodes and runs


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct prefix; rows of one digest must have the same last turn and the same parent."""
    about = ["pa", "pb", "ta", "tb", "words", "total"]
    least, most = ([f(c).alias(f"{c}{end}") for c in about] for f, end in ((F.min, ""), (F.max, "_most")))
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *least, *most)
    agree = F.expr(" AND ".join(f"{c} = {c}_most" for c in about))
    apart = F.raise_error(F.lit("Two prefixes have one digest.")).cast("long")
    return durable(nodes.withColumn("n_convs", F.when(agree, F.col("n_convs")).otherwise(apart)).select(*KEY, "conv_id", "n_convs", *about))


def runs_of(nodes: DataFrame) -> DataFrame:
    """One row for each path of nodes with the same members, by its last digest (``KEY``) and that above its first."""
    return nodes.groupBy("conv_id", "n_convs").agg(
        F.max("depth").alias("depth"),
        *(F.max_by(c, "depth").alias(c) for c in ("da", "db")),
        F.min("depth").alias("first"),
        *(F.min_by(c, "depth").alias(c) for c in ("pa", "pb")),
        F.min(F.col("total") - F.col("words")).alias("above"),
        F.max("total").alias("total"),
    )


# ---- slots


class Slots:
    """A minimal perfect hash of distinct keys, kept with the keys so that strangers are recognised.

    Keys alone in their place at a level get the place's rank as slot; the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        left, used = keys, 0
        while len(left):
            at = self._place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            self.levels.append((np.where(alone, np.cumsum(alone) - 1 + used, -1), 2 * len(left)))
            used += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros_like(keys)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(keys[:, 0] + np.uint64((level * BASE) & _ALL))
        for k in range(1, keys.shape[1]):
            h = mix(h ^ keys[:, k])
        return (h % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for level, (ranks, size) in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            out[open_] = ranks[self._place(keys[open_], level, size)]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for one that is not in the table."""
        out = self._slots(keys)
        return np.where((out >= 0) & (self.keys[out] == keys).all(1), out, -1) if len(self.keys) else out


RUN = ["conv_id", "n_convs", *KEY, "first", "pa", "pb", "above", "total", "children", "leaves", "below"]
COUNTED = ", ".join(f"{c} long" for c in [*RUN, "parent_conv_id"]) + ", inside boolean"


def accumulate(table: pa.Table) -> pa.Table:
    """Children, leaves and saved tokens below each run; what it starts with comes from runs of other shards."""
    c = {n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in RUN}
    own = np.stack([c[k].view(np.uint64) for k in KEY], 1)
    slots = Slots(own)
    slot = slots.find(own)
    # The parent run ends one level above this run's first node; the root has none.
    parent = slots.find(np.stack([(c["first"] - 1).view(np.uint64), c["pa"].view(np.uint64), c["pb"].view(np.uint64)], 1))
    n = len(slot)
    up, depth, inner = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    children, leaves, below, conv = (np.empty(n, np.int64) for _ in range(4))
    up[slot], depth[slot], conv[slot] = parent, c["first"], c["conv_id"]
    inner[slot] = (c["n_convs"] - 1) * (c["total"] - c["above"])
    children[slot], leaves[slot], below[slot] = c["children"], c["leaves"], c["below"]
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        leaves[level] = np.where(children[level] == 0, 1, leaves[level])
        level = level[up[level] >= 0]
        np.add.at(children, up[level], 1)
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(below, up[level], inner[level] + below[level])
    c |= {"children": children[slot], "leaves": leaves[slot], "below": below[slot]}
    above = pa.array(np.where(parent >= 0, conv[parent], 0), mask=parent < 0)
    return pa.table([*(pa.array(c[k]) for k in RUN), above, pa.array(parent >= 0)], names=[*RUN, "parent_conv_id", "inside"])


def shards_of(rows: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """For each conversation the first of its prefixes (``cut``) that at most ``most`` share."""
    larger = nodes.where(F.col("n_convs") > most).select(*KEY)
    deepest = larger.agg(F.max("depth")).first()[0]
    reach = rows.where(F.col("depth") <= (0 if deepest is None else deepest + 1)).select("conv_id", *KEY)
    small = reach.join(larger.withColumn("larger", F.lit(True)), KEY, "left").where("larger IS NULL")
    cut = small.groupBy("conv_id").agg(F.min("depth").alias("depth"), *(F.min_by(c, "depth").alias(c) for c in ("da", "db")))
    return cut.select("conv_id", F.xxhash64(*KEY).alias("cut"))


def counted_runs(rows: DataFrame, nodes: DataFrame, members: int = SHARD_MEMBERS) -> DataFrame:
    """Runs with what lies below them, and the owner of the node above, tier by tier."""
    runs = durable(runs_of(nodes))
    whole = runs.agg(F.max("n_convs")).first()[0] or 0
    parent = ["first", "pa", "pb"]
    done: list[DataFrame] = []
    least, most = 0, members
    while not done or least < whole:
        tier = runs.where((F.col("n_convs") > least) & (F.col("n_convs") <= most))
        zero = F.lit(0).cast("long")
        if done:
            saved = (F.col("n_convs") - 1) * (F.col("total") - F.col("above")) + F.col("below")
            lone = _union(done).where("NOT inside").groupBy(*parent).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum(saved).alias("below"))
            lone = lone.select((F.col("first") - 1).alias("depth"), F.col("pa").alias("da"), F.col("pb").alias("db"), "children", "leaves", "below")
            tier = tier.join(lone, KEY, "left").fillna(0, ["children", "leaves", "below"])
        else:
            tier = tier.withColumns({k: zero for k in ("children", "leaves", "below")})
        shards = tier.count() // SHARD_RUNS + 1
        dealt = tier.join(shards_of(rows, nodes, most), "conv_id").withColumn("shard", F.pmod("cut", F.lit(shards)))
        done.append(durable(dealt.select("shard", *RUN).groupBy("shard").applyInArrow(lambda t: accumulate(t.select(RUN)), COUNTED)))
        least, most = most, most * members
    all_runs = _union(done)
    owners = all_runs.select((F.col("depth") + 1).alias("first"), F.col("da").alias("pa"), F.col("db").alias("pb"), F.col("conv_id").alias("owner"))
    apart = all_runs.where("NOT inside").join(owners, parent, "left").withColumn("parent_conv_id", F.col("owner")).drop("owner")
    return all_runs.where("inside").unionByName(apart)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


# ---- hashes of those that end at a node


def end_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node; ids are joined in order over many tasks, and only blocks meet."""
    order = [*KEY, "conv_id"]
    ended = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if not len(columns[0]):
                continue
            new = np.r_[True, np.any([x[1:] != x[:-1] for x in columns[:3]], 0)]
            begin = np.flatnonzero(new)
            text, first = [], []
            for b, e in zip(begin, np.r_[begin[1:], len(new)], strict=True):
                ids = columns[3][b:e].tolist()
                step = ID_BYTES // 20
                text += [",".join(map(str, ids[k : k + step])).encode() for k in range(0, len(ids), step)]
                first += [b + k for k in range(0, len(ids), step)]
            yield pa.record_batch([*(pa.array(x[first]) for x in columns), pa.array(text, pa.binary())], names=[*order, "ids"])

    blocks = ended.mapInArrow(join, "depth long, da long, db long, conv_id long, ids binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, ids in zip(keys, batch.column(4).to_pylist(), strict=True):
                if key == now:
                    sha.update(b"," + ids)
                    continue
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids)
            yield _digests(done)
        if now is not None:
            yield _digests([(*now, sha.hexdigest())])

    return blocks.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(digest, "depth long, da long, db long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[*KEY, "ends_sha256"])


def prefix_nodes(conversations: DataFrame, shard_members: int = SHARD_MEMBERS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    rows = members(conversations)
    nodes = nodes_of(rows)
    runs = counted_runs(rows, nodes, shard_members).join(end_hashes(rows), KEY, "left")
    about = runs.select(
        "conv_id", "n_convs", "first", F.col("depth").alias("end"), F.col("total").alias("run_total"), "children", "leaves", "below", F.col("parent_conv_id").alias("up"), "ends_sha256"
    )
    last = F.col("depth") == F.col("end")
    saved = (F.col("n_convs") - 1) * (F.col("run_total") - F.col("total") + F.col("words")) + F.col("below")
    return nodes.join(about, ["conv_id", "n_convs"]).select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends_sha256")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
