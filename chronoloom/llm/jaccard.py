"""N-gram Jaccard join: sets in tries, shared partial overlaps, subtrees pruned by remaining lengths.

1. ``sketch``: each document's set of word 5-grams as 64-bit hashes; equal sets form a class, which one row stands for.
   Hash order is the global order.  Two sets with Jaccard t share at least ``share`` of their first hashes, so a set of
   which fewer first hashes are met in other sets has no partner and leaves here.
2. ``candidate_sets``: the sets that are left, and under which hashes they meet.
3. ``trie_links``: sets that meet are put into a path-compressed trie (frequent hashes first, so that near copies share
   long paths).  A probe goes down it carrying the overlap so far, which all sets below share; a subtree is left when
   its lengths, or the hashes that remain on either side, rule t out, or when no set in it meets the probe or all that
   do are already in its component.  Links are a spanning forest of the group's links: none between components is lost.
4. Hashes whose sets are still in several components are open.  Partners share at least a known number of them, so sets
   with fewer leave, and each other set is searched under all but that number of its open hashes, the rarest first.
   Sets that hang together by these hashes are one group, in which only sets that share one are compared.

Groups of many sets, mostly of texts with common lines, are cut into strips of similar sizes.  Strips and groups too large
for one task are split into blocks, and blocks are compared pairwise.  Before a trie is made, sets leave of which less than
t of the hashes are met in other components there: they have no partner.

A null or wordless text has an empty set and no link.  A row without id has no component.  Rows with one id are one
node.  Repeated rows and equal texts are one class.  Only id and text are read.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import byte_texts, chunks, grams, mix, release, word_hashes
from chronoloom.llm.components import components
from chronoloom.session import discard, durable

GRAM = 5
THRESHOLD = Fraction(4, 5)
#: Hashes beyond the shortest prefix, as a part of the set: so many more must be shared, and sets with fewer leave early.
MARGIN = 0.08
#: How often sets with too few open hashes are left out; the result does not depend on it.
FILTER_ROUNDS = 1
#: Hashes of all sets in one block of a group; a larger group is split.
BLOCK_HASHES = 1_000_000
#: A group of more sets is cut into strips; the result does not depend on it.
LARGE_GROUP = 200
#: Each strip begins at so many times the size at which the one before begins; more than 5/4, so partners are in one strip or in neighbours.
STRIP = 1.26
#: Sets are searched together up to so many they ask for and so many bytes that mark their hashes, in steps of so many hashes.
PROBE_ASKED, PROBE_BYTES, PROBE_STEPS = 1 << 16, 1 << 25, 1 << 21
#: Sets of each component that are asked for before the others.
FEW = 8


def shingle_sets(texts: list[bytes], gram: int = GRAM) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; fewer words than n count as one."""
    for low, high in chunks(texts):
        h, begins = word_hashes(texts[low:high], lower=True)
        every = grams(h, gram)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= gram:
                yield np.unique(every[a : b - gram + 1])
            elif b > a:
                yield mix(grams(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _prefix(n: int) -> tuple[int, int]:
    """Length of the prefix of a set of n, and how many of it a partner must share."""
    extra = math.ceil(n * MARGIN)
    shortest = n - math.ceil(THRESHOLD * n) + 1
    length = min(n, shortest + extra)
    return length, max(1, length - shortest + 1)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, key of the set, and its first hashes, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, needs, firsts = [], [], [], []
            for s in shingle_sets(byte_texts(batch.column(1))):
                length, need = _prefix(len(s)) if len(s) else (0, 0)
                sizes.append(len(s))
                needs.append(need)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                firsts.append(s[:length].view(np.int64))
            offsets = np.cumsum([0] + [len(f) for f in firsts])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(needs, pa.int32()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(firsts))),
                ],
                names=["doc_id", "n_shingles", "need", "set_key", "firsts"],
            )

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, need int, set_key binary, firsts array<long>")


def _owned(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted documents; ``wanted`` has doc_id and further columns, which are kept."""
    kept = [c for c in wanted.columns if c != "doc_id"]
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text")).join(wanted, "doc_id")
    joined = joined.select("doc_id", "_text", *kept)
    schema = "doc_id long, hashes binary" + "".join(f", `{c}` {wanted.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(byte_texts(batch.column(1)))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["doc_id", "hashes", *kept])

    return joined.mapInArrow(run, schema)


class Node:
    """A stretch of hashes that all sets below share, and the bounds of their sizes."""

    __slots__ = ("path", "depth", "children", "ends", "low", "high")

    def __init__(self, path: np.ndarray, depth: int, low: int, high: int) -> None:
        self.path, self.depth, self.low, self.high = path, depth, low, high
        self.children: dict[int, Node] = {}
        self.ends: list[int] = []


class Trie:
    """Sets as paths of ranks."""

    def __init__(self) -> None:
        self.top = Node(np.zeros(0, np.int64), 0, 1 << 60, 0)

    def add(self, path: np.ndarray, member: int) -> None:
        n, node, at = len(path), self.top, 0
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                node.ends.append(member)
                return
            child = node.children.get(int(path[at]))
            if child is None:
                leaf = node.children[int(path[at])] = Node(path[at:], n, n, n)
                leaf.ends.append(member)
                return
            m = min(len(child.path), n - at)
            differ = np.flatnonzero(child.path[:m] != path[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.path):
                lower = Node(child.path[same:], child.depth, child.low, child.high)
                lower.children, lower.ends = child.children, child.ends
                child.path, child.depth, child.children, child.ends = child.path[:same], at + same, {int(lower.path[0]): lower}, []
            node, at = child, at + same


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    size = end - begin
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)


class Search:
    """A finished trie as arrays: nodes level by level, so that children stand together, and members in depth-first order,
    so that those of a subtree do.  Ranks from ``shared`` on are in one set only: no path keeps them, and no bound counts them."""

    def __init__(self, trie: Trie, shared: int, held: np.ndarray) -> None:
        nodes = [trie.top]
        for node in nodes:
            nodes += node.children.values()
        number = {id(node): k for k, node in enumerate(nodes)}
        self.child = np.cumsum([1] + [len(node.children) for node in nodes])
        paths = [node.path[: np.searchsorted(node.path, shared)] for node in nodes]
        self.flat = np.concatenate(paths)
        self.path = np.cumsum([0] + [len(path) for path in paths])
        self.tail = np.array([min(node.path[-1], shared - 1) if len(node.path) else -1 for node in nodes])
        self.low, self.high, self.depth = (np.array([getattr(node, f) for node in nodes]) for f in ("low", "high", "depth"))
        self.first, self.own, self.last = (np.zeros(len(nodes), np.int64) for _ in range(3))
        order: list[int] = []
        stack: list[tuple[Node, bool]] = [(trie.top, False)]
        while stack:
            node, done = stack.pop()
            k = number[id(node)]
            if done:
                self.last[k] = len(order)
                continue
            self.first[k] = len(order)
            order += node.ends
            self.own[k] = len(order)
            stack.append((node, True))
            stack += [(c, False) for c in node.children.values()]
        self.members = np.array(order)
        self.place = np.argsort(self.members)
        self.shared = shared
        # The most shared ranks of any set below.
        kept = np.concatenate([held[self.members], [0]])
        self.most = np.maximum.reduceat(kept, np.stack([self.first, self.last], 1).ravel())[::2]

    def similar(self, probes: list[np.ndarray], asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probes (by number) and those of their asked members that are similar to their sorted ranks.

        All probes go down together; each level of the trie is one step.
        """
        count, shared = len(self.members), self.shared
        n, held = np.array([len(p) for p in probes]), [p[: np.searchsorted(p, shared)] for p in probes]
        start = np.cumsum([0] + [len(p) for p in held])
        ranks = np.repeat(np.arange(len(probes)) * shared, np.diff(start)) + np.concatenate(held)
        present = np.zeros(len(probes) * shared, bool)
        present[ranks] = True
        who = np.sort(np.concatenate([k * count + self.place[m] for k, m in enumerate(asked)]))
        out = []
        probe, node, overlap = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        while len(node):
            # Lengths: a partner of n lies between t*n and n/t; and someone below must be asked for.
            fits = (5 * self.high[node] >= 4 * n[probe]) & (4 * self.low[node] <= 5 * n[probe])
            probe, node, overlap = probe[fits], node[fits], overlap[fits]
            some = np.searchsorted(who, probe * count + self.first[node])
            fits = some < np.searchsorted(who, probe * count + self.last[node])
            probe, node, overlap, some = probe[fits], node[fits], overlap[fits], some[fits]
            overlap = overlap + self._met(present, probe * shared, node)
            # What is left: of any set below what it shares behind depth at most, of the probe what ranks behind this path.
            behind = start[probe + 1] - np.searchsorted(ranks, probe * shared + self.tail[node], "right")
            most = overlap + np.minimum(np.maximum(self.most[node] - self.depth[node], 0), behind)
            fits = 9 * most >= 4 * (n[probe] + np.maximum(self.low[node], (4 * n[probe] + 4) // 5))
            probe, node, overlap, some = probe[fits], node[fits], overlap[fits], some[fits]
            full = 9 * overlap >= 4 * (n[probe] + self.depth[node])
            out.append(who[_ranges(some[full], np.searchsorted(who, probe[full] * count + self.own[node[full]]))])
            size = self.child[node + 1] - self.child[node]
            probe, node, overlap = np.repeat(probe, size), _ranges(self.child[node], self.child[node + 1]), np.repeat(overlap, size)
        found = np.concatenate(out)
        return found // count, self.members[found % count]

    def _met(self, present: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """How many ranks of each node's path are present in the row that begins there."""
        begin, size = self.path[node], self.path[node + 1] - self.path[node]
        steps = np.cumsum(size)
        cuts = np.searchsorted(steps, np.arange(PROBE_STEPS, steps[-1], PROBE_STEPS)) if len(node) else []
        out = [np.zeros(0, np.int64)]
        for a, b in itertools.pairwise(np.unique([0, *cuts, len(node)]).tolist()):
            n = size[a:b]
            at = _ranges(begin[a:b], begin[a:b] + n)
            hits = np.concatenate([[0], np.cumsum(present[np.repeat(row[a:b], n) + self.flat[at]])])
            stop = np.cumsum(n)
            out.append(hits[stop] - hits[stop - n])
        return np.concatenate(out)


def spanning_links(
    sets: list[np.ndarray],
    component: list[int],
    keys: list[list[int]] | None = None,
    block: list[int] | None = None,
    guest: list[bool] | None = None,
) -> list[tuple[int, int]]:
    """Pairs of set numbers: a spanning forest of the links between given components.

    Only sets that share one of their ``keys`` are compared (all, where these are not given), with ``block`` (0 or 1)
    only sets of different blocks, and with ``guest`` no two guests.
    """
    stay = _sifted(sets, component, block, guest).tolist()
    if len(stay) < 2:
        return []
    found = _forest(*([x[k] for k in stay] if x else None for x in (sets, component, keys, block, guest)))
    return [(stay[j], stay[i]) for j, i in found]


def _forest(
    sets: list[np.ndarray], component: list[int], keys: list[list[int]] | None, block: list[int] | None, guest: list[bool] | None
) -> list[tuple[int, int]]:
    """The links of :func:`spanning_links`, through a trie of all sets."""
    every = np.concatenate(sets)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    paths = [np.sort(p) for p in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    trie = Trie()
    for i, path in enumerate(paths):
        trie.add(path, i)
    shared = int((counts > 1).sum())
    search = Search(trie, shared, np.array([np.searchsorted(path, shared) for path in paths]))
    size = np.array([len(p) for p in paths])
    label = np.unique(component, return_inverse=True)[1]
    side = np.array(block) if block else None
    visits = np.array(guest) if guest else None
    listed: dict[int, list[int]] = {}
    for i, own in enumerate(keys or [[0]] * len(sets)):
        for k in own:
            listed.setdefault(k, []).append(i)
    members = {k: np.array(m) for k, m in listed.items() if len(m) > 1}
    out = []

    def link(probes: list[int], asked: list[np.ndarray]) -> None:
        k, found = search.similar([paths[i] for i in probes], asked)
        one = np.unique(k * len(sets) + label[found], return_index=True)[1]
        for i, j in zip(np.array(probes)[k[one]].tolist(), found[one].tolist(), strict=True):
            if label[j] != label[i]:
                out.append((j, i))
                label[label == label[i]] = label[j]

    def flush(probes: list[int], asked: list[np.ndarray]) -> None:
        # A few of each component first: most copies are found there, and no more is asked about their component.
        few = [_few(near, label[near]) if len(near) > 2 * FEW else near for near in asked]
        many = [k for k, near in enumerate(asked) if 2 * len(few[k]) <= len(near)]
        if many:
            link([probes[k] for k in many], [few[k] for k in many])
            asked = [near[label[near] != label[i]] for i, near in zip(probes, asked, strict=True)]
            for k in many:
                asked[k] = np.setdiff1d(asked[k], few[k], assume_unique=True)
        rest = [k for k, near in enumerate(asked) if len(near)]
        if rest:
            link([probes[k] for k in rest], [asked[k] for k in rest])

    probes: list[int] = []
    asked: list[np.ndarray] = []
    total = 0
    for i in range(len(sets)):
        lists = [m for m in (members.get(k) for k in (keys[i] if keys else [0])) if m is not None]
        if not lists:
            continue
        near = lists[0][: np.searchsorted(lists[0], i)]
        if len(lists) > 1:
            meets = np.zeros(i, bool)
            for m in lists:
                meets[m[: np.searchsorted(m, i)]] = True
            near = np.flatnonzero(meets)
        near = near[(label[near] != label[i]) & (5 * size[near] >= 4 * size[i]) & (4 * size[near] <= 5 * size[i])]
        if side is not None:
            near = near[side[near] != side[i]]
        if visits is not None and visits[i]:
            near = near[~visits[near]]
        if not len(near):
            continue
        probes.append(i)
        asked.append(near)
        total += len(near)
        if total > PROBE_ASKED or len(probes) * shared > PROBE_BYTES:
            flush(probes, asked)
            probes, asked, total = [], [], 0
    if probes:
        flush(probes, asked)
    return out


def _sifted(sets: list[np.ndarray], component: list[int], block: list[int] | None, guest: list[bool] | None) -> np.ndarray:
    """Numbers of the sets that can have a partner.

    A partner holds 4/5 of a set's hashes at least, so as many must be met in other components, by sets that it may be
    compared with.  What leaves takes its hashes along.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    label = np.unique(component, return_inverse=True)[1]
    kinds = [np.array(block) == 0, np.array(block) == 1] if block else []
    kinds += [~np.array(guest)] if guest else []
    left = len(sets)
    while True:
        low, high = np.full(len(values), len(sets)), np.full(len(values), -1)
        np.minimum.at(low, inverse, label[owner])
        np.maximum.at(high, inverse, label[owner])
        met = low < high
        for kind in kinds:
            held = np.zeros(len(values), bool)
            held[inverse[kind[owner]]] = True
            met &= held
        stays = 5 * np.bincount(owner[met[inverse]], minlength=len(sets)) >= 4 * size
        before, left = left, int(stays.sum())
        # The few that would still leave later cost less in the trie.
        if 10 * (before - left) <= before:
            return np.flatnonzero(stays)
        keep = stays[owner]
        owner, inverse = owner[keep], inverse[keep]


def _few(near: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The first FEW sets of each label."""
    order = np.argsort(label, kind="stable")
    begins = np.flatnonzero(np.diff(label[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    return near[np.sort(order[place < FEW])]


def stars(component: list[int], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(smallest, other) of the components that pairs of set numbers join."""
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (c := up.get(d := c, d)) != d:
            pass
        return c

    for i, j in pairs:
        x, y = root(component[i]), root(component[j])
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(root(c), c) for c in up]


def trie_links(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) of components within the groups of rows (hashes, component, side, guest, and shared keys where not all meet)."""

    def run(group: pa.Table) -> pa.Table:
        component = group.column("component").to_pylist()
        found = []
        if len(component) > 1:
            sets = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
            sides, guests = group.column("side").to_pylist(), group.column("guest").to_pylist()
            shared = group.column("shared").to_pylist() if "shared" in group.column_names else None
            found = stars(component, spanning_links(sets, component, shared, sides if any(sides) else None, guests if any(guests) else None))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return grouped.groupBy(*keys).applyInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = durable(sketch(docs))
    # What the result needs of every row is stored apart from the hashes, which are deleted as soon as they are counted.
    sized = durable(sketches.select("doc_id", "n_shingles", "set_key", "need"))
    classes = durable(sized.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")))

    # Hashes that different sets have among their first ones, and the sets that have enough of them.  They are shuffled
    # once: grouping by hash and set and counting the sets of a hash both find them dealt by hash.
    firsts = sketches.where("doc_id IS NOT NULL").select(F.explode("firsts").alias("h"), F.xxhash64("set_key").alias("k"), "doc_id")
    once = firsts.repartition("h").groupBy("h", "k").agg(F.min("doc_id").alias("doc_id"))
    met = durable(once.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1").select("doc_id", "h"))
    discard(sketches)
    release(spark)
    # An id with several texts has the least need of any, which leaves nothing out.
    needs = classes.join(sized, ["set_key", "doc_id"]).groupBy("doc_id").agg(F.min("need").alias("need"))
    enough = met.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("g")).join(needs, "doc_id").where("n >= need")
    enough = enough.select("doc_id", "g", "need")
    sets = durable(_owned(docs, enough).withColumn("size", (F.octet_length("hashes") / 8).cast("long")))
    release(spark)
    every = met
    met = durable(every.join(sets.select("doc_id", "need").distinct(), "doc_id").select("doc_id", "need", "h"))
    discard(every)

    # First under one hash each: near copies mostly meet there, and the rest of the work knows their components.
    same_id = _links_of_ids(sized, classes)
    known = components(_block_links(_labelled(sets.select("doc_id", "size", "hashes", F.col("g").alias("group")), None)).unionByName(same_id))
    release(spark)

    # Then under hashes whose sets are not all in one component, as far as a set has enough of these.
    open_ = met
    for _ in range(FILTER_ROUNDS):
        named = _labelled(open_, known)
        several = named.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("h")
        named = named.join(several, "h").select("doc_id", "need", "h")
        able = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("doc_id", "n")
        before, open_ = open_, durable(named.join(able.select("doc_id"), "doc_id", "left_semi"))
        discard(before)
        release(spark)
    # Partners share at least ``need`` of these, so each set leaves out its last need - 1, those that most sets have.
    spread = open_.groupBy("h").agg(F.count("*").alias("n"))
    ranked = open_.join(spread, "h").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h")))
    held = open_.groupBy("doc_id").agg((F.count("*") - F.max("need") + 1).alias("most"))
    members = ranked.join(held, "doc_id").where("place <= most").select("doc_id", "h")
    members = _labelled(members, known)
    several = members.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("b")).where("low != high").select("h", "b")
    members = durable(members.join(several, "h"))
    discard(open_)
    # Sets that hang together by such hashes are searched in one place, each sent once with its hashes.
    clusters = components(members.select(F.col("doc_id").alias("a"), "b"))
    release(spark)
    once = members.groupBy("doc_id").agg(F.first("component").alias("component"), F.collect_set("h").alias("shared"))
    once = durable(once.join(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("group")), "doc_id"))
    more = durable(_block_links(once.join(sets.select("doc_id", "size", "hashes"), "doc_id")))
    discard(sets, members, clusters, once)
    release(spark)
    if not more.isEmpty():
        # Links now join components: a document takes what its component is called.
        joined = components(more).select(F.col("id").alias("component"), F.col("component").alias("c"))
        every = known.unionByName(joined.select(F.col("component").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
        known = durable(every.join(joined, "component", "left").select("id", F.coalesce("c", "component").alias("component")))

    by_class = classes.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "set_key", F.coalesce("component", "doc_id").alias("class_component")
    )
    # A row is named by its own id where it stands alone, so rows without words keep theirs.
    return sized.drop("need").join(by_class, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id")
    )


def _links_of_ids(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that have one id but unlike texts."""
    own = sized.where("set_key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_key")
    unlike = own.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low != high").select("doc_id")
    named = own.join(unlike, "doc_id").distinct().join(classes.withColumnRenamed("doc_id", "class"), "set_key")
    least = named.groupBy("doc_id").agg(F.min("class").alias("a"))
    return named.join(least, "doc_id").where("class != a").select("a", F.col("class").alias("b")).distinct()


def _labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows with the component of their document, its own id where no link is known."""
    if known is None:
        return rows.withColumn("component", F.col("doc_id"))
    joined = rows.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def _block_links(rows: DataFrame) -> DataFrame:
    """Links of rows (doc_id, size, hashes, component, group and perhaps shared) within their groups.

    A group over LARGE_GROUP is cut into strips by size: a set belongs to one and is a guest in the next, where it meets
    those that belong there.  A strip or smaller group over BLOCK_HASHES is cut into blocks by document; each block is
    searched alone, and then each two blocks against each other.
    """
    sizes = durable(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    few = rows.join(sizes.where(F.col("n") <= LARGE_GROUP).select("group"), "group")
    few = few.withColumn("strip", F.lit(0)).withColumn("guest", F.lit(False))
    many = rows.join(sizes.where(F.col("n") > LARGE_GROUP).select("group"), "group")
    first = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(STRIP)).cast("int") + 1
    many = many.withColumn("own", first).withColumn("strip", F.explode(F.array("own", F.col("own") + 1)))
    many = many.withColumn("guest", F.col("own") != F.col("strip")).drop("own")
    every = few.unionByName(many)
    cut = every.groupBy("group", "strip").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.every("guest").alias("guests"))
    cut = cut.where("n > 1 AND NOT guests").select("group", "strip", F.ceil(F.col("s") / BLOCK_HASHES).cast("int").alias("cuts"))
    placed = every.join(cut, ["group", "strip"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    # Block i meets every block j: key (min, max); within its own key it is searched alone.
    others = F.when(F.col("cuts") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
    spread = placed.withColumn("other", F.explode(others)).select(
        *rows.columns,
        "strip", "guest",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    return trie_links(spread, ["group", "strip", "i", "j"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the smallest id of each component; rows without id stay."""
    found = similar_components(docs).where("doc_id IS NOT NULL")
    # Most ids stay and have one row that is named by it: the few others are joined, so that they can be sent to the rows.
    own = found.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("own"))
    others = durable(own.where("own != 1"))
    rows = docs.where("doc_id IS NOT NULL").join(others.where("own = 0").select("doc_id"), "doc_id", "left_anti")
    if not others.where("own > 1").isEmpty():
        # Rows that share an id are one document: the one with the smallest text stays.
        columns = rows.columns
        packed = rows.select("doc_id", "text", F.struct(*columns).alias("row"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        rows = packed.select("row", place.alias("place")).where("place = 1").select("row.*")
    return rows.unionByName(docs.where("doc_id IS NULL"))
