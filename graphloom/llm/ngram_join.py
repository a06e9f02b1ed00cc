"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

A document is the set of its distinct word shingles (64-bit hashes of the words, A-Z lower-cased). Documents of equal sets are
one node. A set of n shingles can only link to a set with which it shares at least T = ceil(threshold * n) of them, and two
sets that link without being equal have MIN_SIZE shingles at least. Shingles are put in one order for the whole corpus,
rare ones first; the first n - T + SHARED of a set are its short inverted lists, the rest its long ones: linked sets share at
least SHARED short lists. (This is the T-occurrence problem with DivideSkip's split, where the number of long lists L is
T - SHARED: whoever occurs fewer than T - L times in the short lists cannot reach T.) Short lists are merged by counting
occurrences; the long lists of those who pass are not read but probed, by binary search for their shingles in
the candidate's sorted set.

1. Profile: every text's set size and node (a digest of the set); a scan. A second digest tells apart sets that share the first:
   those few nodes are then named by the second one, so that sets are told apart by 128 bits.
2. Frequencies: every set's shingles, as packed 32-bit remainders under their leading bits, are counted where the leading
   bits meet, after those of many documents were combined. They give a bitmap of fixed size that says which
   shingles may occur twice (the others need no list), and the most frequent shingles, as many as fit the bound; a scan.
3. Short lists: (shingle, node) rows of the shingles that may occur twice; a scan.
4. Lists of up to SMALL nodes are merged by counting pairs. In a longer list every node is paired with the list's centre (the
   node of the fewest rare shingles), which settles near copies of one original in linear work.
5. Sets of candidates are read from the texts (a scan), and the pairs are measured: links are exact (100 * common >= percent * union),
   and a node's Jaccard distance to a centre puts it on a ring around it, rings being as wide as the greatest distance of a link.
6. Components of the links are found by star steps. Two nodes of one long list have its centre in common; as the distance is a metric they
   can link only on the same or on adjacent rings. Nodes that share no component with their centre therefore meet the nodes on
   three rings of that centre, in blocks; each block pair is one T-occurrence search that yields a spanning forest of the links between components.

The order of shingles only steers the work: frequencies that the bound leaves out cost time, never a link. No pairs of a large
group are listed. What is left to the last step is quadratic only among nodes that share rare lists, don't link to their centre and lie about as far from it.

Defined results: null text and text without words is an empty set, linked with nothing; text of fewer words than a shingle has the
whole sequence as its one shingle; repeated rows and copies share a node; a null id takes no part in the choice of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Words, as_long, materialize, mix64, shingle_hashes, text_batches
from graphloom.operators.components import connected_components
from graphloom.plans.tables import discard

SHARED = 3
SMALL = 32
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
"""Shingles of a block's sets, about: 2 MB."""
BITMAP_BITS = 27
"""The bitmap of repeated shingles has 2^27 bits (16 MB) whatever the corpus."""
MOST_FREQUENT = 1 << 18
"""Shingles whose frequency is known to all tasks; 12 bytes each."""
FREQUENT = 16
MOST_SHARED_DIGESTS = 100_000
"""Nodes named by their second digest at most; some hundreds are expected of 10^11 texts."""
NODE_BITMAP_BITS = 21
FLUSH = 1 << 20
UNSIGNED = np.uint64


@dataclass(frozen=True)
class Rule:
    width: int = 4
    percent: int = 85
    digest_bits: int = 64
    """Leading bits of the first digest that name a node; fewer in tests."""

    def __post_init__(self) -> None:
        if not (self.width > 0 and 0 < self.percent < 100 and 0 < self.digest_bits <= 64):
            raise ValueError(f"no rule of near copies: {self}")

    @property
    def least_size(self) -> int:
        """Sets of fewer shingles link to equal sets alone: k / (k + 1) stays below the threshold."""
        k = 1
        while 100 * k < self.percent * (k + 1):
            k += 1
        return k

    def need(self, n: int) -> int:
        """Least overlap of a set of n shingles with any set it links to."""
        return -(-self.percent * n // 100)

    def links(self, a: int, b: int, common: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def ring(self, a: int, b: int, common: int) -> int:
        """0 for a link; else in which multiple of the greatest distance of a link the distance lies. Sets that link are on the same or adjacent rings of any third set."""
        union = a + b - common
        return max(0, -(-100 * (union - common) // ((100 - self.percent) * union)) - 1)


def text_sets(raw: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    w = Words(raw, off, "space")
    whole = shingle_hashes(w.hash, width) if len(w.hash) >= width else np.zeros(0, UNSIGNED)
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = hi - lo
        if n >= width:
            s = np.sort(whole[lo : hi - width + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        else:
            yield shingle_hashes(w.hash[lo:hi], n) if n else np.zeros(0, UNSIGNED)


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent digests of a set, as signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        own = UNSIGNED(len(s)) * UNSIGNED(0x9E3779B97F4A7C15)
        a = mix64(mix64(s).sum(dtype=UNSIGNED) + own)
        b = mix64(mix64(s ^ UNSIGNED(0xA5A5A5A5A5A5A5A5)).sum(dtype=UNSIGNED) ^ own)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def node_of(s: np.ndarray, rule: Rule, shared: frozenset[int]) -> tuple[int, int]:
    """(node, check) of a set; shared: nodes that are more than one set's first digest. Equal checks of one node mean equal sets."""
    first, second = digests(s)
    node = (first >> (64 - rule.digest_bits)) << (64 - rule.digest_bits)
    return (second, first) if node in shared else (node, second)


def profile(docs: DataFrame, rule: Rule, shared: frozenset[int]) -> DataFrame:
    """(id, n, node, check) of every row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node = [], []
            for _, _, raw, off in text_batches(b, 1):
                for s in text_sets(raw, off, rule.width):
                    n.append(len(s))
                    node.append(node_of(s, rule, shared) if len(s) else (None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([x for x, _ in node], pa.int64()), pa.array([y for _, y in node], pa.int64())], ["id", "n", "node", "check"])

    return docs.mapInArrow(run, docs.select("id").schema.add("n", "long").add("node", "long").add("check", "long"))


def named_sets(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(profile, nodes, shared): nodes has a row (node, low, n) a set, low being its smallest id; shared as in node_of."""
    shared: frozenset[int] = frozenset()
    while True:
        seen = materialize(profile(docs, rule, shared), "profile")
        of = seen.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.first("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        nodes = materialize(of, "nodes")
        more = {r["node"] for r in nodes.filter("c0 <> c1").select("node").limit(MOST_SHARED_DIGESTS + 1).collect()}
        if not more:
            return seen, nodes.select("node", "low", "n"), shared
        shared |= more
        discard(seen, nodes)
        if len(shared) > MOST_SHARED_DIGESTS:
            raise RuntimeError("the digests of too many texts are equal")


def _new_sets(batches: Iterator[pa.RecordBatch], rule: Rule, shared: frozenset[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets that can link to others, each once a task."""
    seen: set[int] = set()
    for b in batches:
        for _, _, raw, off in text_batches(b, 1):
            for s in text_sets(raw, off, rule.width):
                if len(s) >= rule.least_size and (node := node_of(s, rule, shared)[0]) not in seen:
                    seen.add(node)
                    yield node, s


def frequencies(docs: DataFrame, rule: Rule, shared: frozenset[int], lead: int) -> DataFrame:
    """(bucket, bits, tokens, counts): for each value of the leading bits, its part of the bitmap and its frequent shingles (lead + 32 leading bits)."""
    inner = BITMAP_BITS - lead

    def pack(h: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = np.sort(np.concatenate(h))
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        count = np.diff(np.append(new, len(s)))
        s = s[new]
        bucket = (s >> UNSIGNED(64 - lead)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange((1 << lead) + 1))
        short = ((s >> UNSIGNED(32 - lead)) & UNSIGNED(0xFFFFFFFF)).astype(np.uint32)
        rows = [(b, short[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([t[c == 1].tobytes() for _, t, c in rows], pa.binary()), pa.array([t[c > 1].tobytes() for _, t, c in rows], pa.binary()), pa.array([c[c > 1].astype(np.uint32).tobytes() for _, _, c in rows], pa.binary())],
            ["bucket", "once", "more", "counts"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, s in _new_sets(batches, rule, shared):
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    def count(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint32)
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint32)
        times = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        both = np.concatenate([once, more])
        order = np.argsort(both, kind="stable")
        s, c = both[order], np.concatenate([np.ones(len(once), np.int64), times.astype(np.int64)])[order]
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        total = np.add.reduceat(c, new)
        twice = s[new][total > 1]
        bits = np.zeros(1 << inner, bool)
        bits[(twice >> np.uint32(32 - inner)).astype(np.int64) if inner else np.zeros(len(twice), np.int64)] = True
        often = total >= FREQUENT
        bucket = table.column("bucket")[0].as_py()
        tokens = (np.int64(bucket) << np.int64(32)) | s[new][often].astype(np.int64)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "tokens": pa.array([tokens.tolist()], pa.list_(pa.int64())), "counts": pa.array([total[often].tolist()], pa.list_(pa.int64()))})

    parts = docs.mapInArrow(scan, "bucket int, once binary, more binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(count, "bucket int, bits binary, tokens array<long>, counts array<long>")


@dataclass
class Order:
    """The order of shingles: bitmap of those that may occur twice, and the frequent ones with their frequencies."""

    bits: np.ndarray
    lead: int
    tokens: np.ndarray
    counts: np.ndarray

    def rank(self, s: np.ndarray) -> np.ndarray:
        """-1: occurs once; 0: may occur twice; else the frequency."""
        at = (s >> UNSIGNED(64 - BITMAP_BITS)).astype(np.int64)
        twice = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        rank = twice.astype(np.int64) - 1
        if len(self.tokens):
            some = np.flatnonzero(rank == 0)
            t = (s[some] >> UNSIGNED(32 - self.lead)).astype(np.int64)
            i = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
            rank[some] = np.where(self.tokens[i] == t, self.counts[i], 0)
        return rank


def shingle_order(docs: DataFrame, rule: Rule, shared: frozenset[int], total: int) -> Order:
    """total: shingles of all sets; it sets how many leading bits deal them out."""
    lead = int(min(20, max(6, np.ceil(np.log2(max(1, total) / (1 << 19))))))
    found = materialize(frequencies(docs, rule, shared, lead), "shingle-frequencies")
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    size = (1 << (BITMAP_BITS - lead)) // 8
    parts = found.select("bucket", "bits").toArrow()
    for b, own in zip(parts.column("bucket").to_pylist(), parts.column("bits"), strict=True):
        bits[b * size : (b + 1) * size] = np.frombuffer(own.as_buffer(), np.uint8)
    del parts
    each = found.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("x.tokens", "x.counts")
    steps = sorted((r["k"], r["count"]) for r in each.groupBy(F.floor(F.log2("counts")).alias("k")).count().collect())
    least, kept = None, 0
    for k, n in reversed(steps):
        if kept + n > MOST_FREQUENT:
            break
        least, kept = k, kept + n
    if least is None:
        discard(found)
        return Order(bits, lead, np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = each.filter(F.floor(F.log2("counts")) >= least).toArrow()
    discard(found)
    tokens, counts = (rows.column(c).to_numpy() for c in ("tokens", "counts"))
    order = np.argsort(tokens)
    return Order(bits, lead, tokens[order], counts[order])


def short_lists(docs: DataFrame, rule: Rule, shared: frozenset[int], order: Order) -> DataFrame:
    """(h, node, n, rare) rows: a node's short lists, but for shingles that occur once; rare: how many of its shingles do."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k = [len(h) for h, _, _, _ in held]
            cols = [as_long(np.concatenate([h for h, _, _, _ in held]))] + [np.repeat(np.array([x[i] for x in held], np.int64), k) for i in (1, 2, 3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "node", "n", "rare"])

        for node, s in _new_sets(batches, rule, shared):
            rank = sent.value.rank(s)
            first = np.lexsort((s, rank))[: len(s) - rule.need(len(s)) + SHARED]
            first = first[rank[first] >= 0]
            if len(first):
                held.append((s[first], node, len(s), int((rank < 0).sum())))
                size += len(first)
                if size >= FLUSH // 4:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = materialize(docs.mapInArrow(run, "h long, node long, n long, rare long").distinct(), "short-lists")
    sent.destroy()
    return found


def node_sets(docs: DataFrame, rule: Rule, shared: frozenset[int], nodes: DataFrame) -> DataFrame:
    """(node, shingles): the sorted sets of nodes, read from the texts. A bitmap of fixed size keeps most other sets off the shuffle."""
    spark = docs.sparkSession
    width = 1 << NODE_BITMAP_BITS
    place = F.shiftrightunsigned("node", 64 - NODE_BITMAP_BITS)
    part = F.shiftright(place, 12).cast("int")
    # At most 2^21 places reach the driver, whatever the number of nodes.
    marks = nodes.select(part.alias("part"), (place.bitwiseAND(F.lit(4095))).cast("int").alias("at")).groupBy("part").agg(F.collect_set("at").alias("at"))
    bits = np.zeros(width, bool)
    for r in marks.collect():
        bits[np.array(r["at"], np.int64) + (r["part"] << 12)] = True
    sent = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        held, size = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([s for _, s in held], pa.binary())], ["node", "shingles"])
        for node, s in _new_sets(batches, rule, shared):
            at = (node & ((1 << 64) - 1)) >> (64 - NODE_BITMAP_BITS)
            if wanted[at >> 3] >> (7 - (at & 7)) & 1:
                held.append((node, s.tobytes()))
                size += 8 * len(s)
                if size > 4 << 20:
                    yield make()
                    held, size = [], 0
        if held:
            yield make()

    found = docs.mapInArrow(run, "node long, shingles binary").join(nodes.hint("merge"), "node", "left_semi")
    # Several tasks may have met copies of one text.
    found = materialize(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    sent.destroy()
    return found


def small_list_pairs(lists: DataFrame, rule: Rule) -> DataFrame:
    """(a, b), a < b, of nodes that share SHARED of the lists (h, node, n), each of which has SMALL nodes at most: occurrences, merged by counting."""
    rows = lists.groupBy("h").agg(F.collect_list(F.struct("node", "n")).alias("l"))
    # Sizes too far apart cannot link.
    near = lambda x, y: (y["node"] > x["node"]) & (100 * F.least(x["n"], y["n"]) >= rule.percent * F.greatest(x["n"], y["n"]))
    met = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: near(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    pairs = rows.select(F.explode(met).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= SHARED).select("a", "b")


def measured(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, star, ring) of pairs (a, b, star): those that link, and all of stars. Shingles of the smaller set are probed in the larger by binary search."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = x.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b").select("a", "b", "star", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            ring = []
            for x, y in zip(r.column(3), r.column(4), strict=True):
                p, q = np.frombuffer(x.as_buffer(), UNSIGNED), np.frombuffer(y.as_buffer(), UNSIGNED)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                ring.append(rule.ring(len(p), len(q), int((q[at] == p).sum())))
            ring = pa.array(ring, pa.int32())
            keep = pc.or_(pc.equal(ring, 0), r.column(2))
            yield pa.RecordBatch.from_arrays([*r.columns[:3], ring], ["a", "b", "star", "ring"]).filter(keep)

    return both.mapInArrow(run, "a long, b long, star boolean, ring int")


def divide_skip(query: np.ndarray, tokens: np.ndarray, begin: np.ndarray, owner: np.ndarray, sets: list[np.ndarray], need: int) -> np.ndarray:
    """Members whose sets share at least `need` shingles with the query.

    tokens, begin, owner: an inverted index (sorted shingles, where each list begins, members). The longest need - 1 lists, or as many as
    are longer than the mean list, are the long ones: they are probed for the members that occur often enough in the others.
    """
    i = np.minimum(np.searchsorted(tokens, query), len(tokens) - 1)
    i = i[tokens[i] == query]
    if len(i) < need:
        return np.zeros(0, np.int64)
    size = begin[i + 1] - begin[i]
    order = np.argsort(size, kind="stable")
    long = min(need - 1, int((size > size.mean()).sum()))
    short = i[order[: len(i) - long]]
    reach = size[order[: len(i) - long]]
    take = np.repeat(begin[short], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    count = np.bincount(owner[take], minlength=len(sets))
    found = np.flatnonzero(count >= need - long)
    if not long:
        return found
    probe = np.sort(tokens[i[order[len(i) - long :]]])
    out = []
    for m in found.tolist():
        at = np.minimum(np.searchsorted(sets[m], probe), len(sets[m]) - 1)
        if count[m] + int((sets[m][at] == probe).sum()) >= need:
            out.append(m)
    return np.array(out, np.int64)


def block_links(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]], rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between the components of two blocks of (component, set)."""
    sets = [s for _, s in b]
    if not a or not sets:
        return []
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    tokens, begin = flat[new], np.append(new, len(flat))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for part, s in a:
        for m in divide_skip(s, tokens, begin, own, sets, rule.need(len(s))).tolist():
            other, t = b[m]
            p, q = top(part), top(other)
            if p == q:
                continue
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            if rule.links(len(s), len(t), int((t[at] == s).sum())):
                root[max(p, q)] = min(p, q)
                out.append((part, other))
    return out


def ring_links(asks: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between components, of the nodes of asks with those of members that lie on the same or adjacent rings of their centre, in blocks.

    asks, members: (centre, ring, node, n, part).
    """
    blocks = (F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)))).cast("int")
    key = ["centre", "ring"]

    def packed(rows: DataFrame, name: str) -> DataFrame:
        size = materialize(rows.groupBy(*key).agg(blocks.alias("blocks")), "ring-sizes")
        dealt = rows.join(size.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.join(sets.hint("merge"), "node")
        return materialize(dealt.groupBy(*key, "block").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("part", "shingles")).alias(name)), f"blocks-{name}")

    b, a = packed(members, "b"), packed(asks, "a")
    # Who asks goes to the blocks of three rings.
    out = a.select("centre", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"), "block", "a").withColumnRenamed("block", "from")
    size = b.groupBy(*key).agg(F.max("blocks").alias("blocks"))
    out = out.join(size.hint("merge"), key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "from")
    met = out.join(b.select(*key, "block", "b").hint("merge"), [*key, "block"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: [(r["part"], np.frombuffer(r["shingles"], UNSIGNED)) for r in x.as_py()]
        for r in batches:
            for x, y in zip(r.column(0), r.column(1), strict=True):
                got = block_links(read(x), read(y), rule)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([q for _, q in got], pa.int64())], ["a", "b"])

    # A block pair is work, not bytes: they are dealt out evenly.
    met = met.repartition(4 * max(1, asks.sparkSession.sparkContext.defaultParallelism))
    found = materialize(met.mapInArrow(run, "a long, b long").filter("a <> b").distinct(), "ring-links")
    discard(a, b)
    return found


def linked_parts(docs: DataFrame, rule: Rule, shared: frozenset[int], total: int) -> DataFrame:
    """(node, part): the component of every node that links to another one, of (id, text) rows."""
    order = shingle_order(docs, rule, shared, total)
    rows = short_lists(docs, rule, shared, order)
    lists = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("rare", "node")).alias("c")).filter("k > 1").select("h", "k", F.col("c.node").alias("centre"))
    # A table of its own: only then can Spark split the join where a list is long.
    lists = materialize(lists, "lists")
    tagged = materialize(rows.join(lists.hint("merge"), "h").select("h", "node", "n", "k", "centre"), "listed")
    discard(rows, lists)
    pairs = small_list_pairs(tagged.filter(F.col("k") <= SMALL), rule).withColumn("star", F.lit(False)).withColumn("n", F.lit(0).cast("long"))
    star = tagged.filter((F.col("k") > SMALL) & (F.col("node") != F.col("centre"))).select(F.col("node").alias("a"), F.col("centre").alias("b"), F.lit(True).alias("star"), "n").distinct()
    asked = materialize(pairs.unionByName(star), "pairs")
    discard(tagged)
    sets = node_sets(docs, rule, shared, asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("b").alias("node"))).distinct())
    found = materialize(measured(asked.select("a", "b", "star"), sets, rule), "measured")
    parts = materialize(connected_components(found.filter("ring = 0"), "a", "b").withColumnRenamed("component", "part"), "parts")
    if found.filter("ring > 0").limit(1).count():
        # Around each centre: its nodes with their rings and components, and itself.
        about = found.filter("star").join(asked.filter("star").select("a", "b", "n").hint("merge"), ["a", "b"]).select(F.col("b").alias("centre"), F.col("a").alias("node"), "ring", "n")
        about = about.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        main = parts.select(F.col("node").alias("centre"), F.col("part").alias("main"))
        around = materialize(about.join(main.hint("merge"), "centre", "left").withColumn("main", F.coalesce("main", "centre")), "around")
        asks = around.filter("part <> main").drop("main")
        if asks.limit(1).count():
            own = around.select("centre", F.col("main").alias("part")).distinct().select("centre", F.lit(0).alias("ring"), F.col("centre").alias("node"), F.lit(1).cast("long").alias("n"), "part")
            members = around.drop("main").unionByName(own)
            more = ring_links(asks, members, sets, rule)
            top = materialize(connected_components(more, "a", "b").select(F.col("node").alias("part"), "component"), "top")
            # Components that link further; a node without links before is a component of its own.
            lone = top.join(parts.select("part").distinct().hint("merge"), "part", "left_anti").select(F.col("part").alias("node"), F.col("component").alias("part"))
            joined = parts.join(top.hint("merge"), "part", "left").select("node", F.coalesce("component", "part").alias("part"))
            spent, parts = parts, materialize(joined.unionByName(lone), "parts")
            discard(spent, more, top)
        discard(around)
    discard(asked, sets, found)
    return parts


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(id_col, n_shingles, component_id): the smallest id that links reach, the row's own included."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    seen, nodes, shared = named_sets(rows, rule)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    parts = linked_parts(rows, rule, shared, total)
    placed = nodes.select("node", "low").join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = materialize(placed, "placed")
    lows = materialize(placed.groupBy("part").agg(F.min("low").alias("component_id")), "lows")
    placed = materialize(placed.join(lows.hint("merge"), "part").select("node", "component_id"), "node-components")
    found = seen.filter("node is not null").join(placed.hint("merge"), "node").select("id", "n", "component_id")
    lone = seen.filter("node is null").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
