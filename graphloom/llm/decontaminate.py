"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of `width` consecutive words of the benchmark items (an item of fewer words is one
window). They are searched by classes of equal length. For each class a shift table over hashed blocks of two
words says how far the scan may jump; where the jump is zero, the last block's hash selects a bucket of
windows, and a direct comparison of the words confirms an occurrence. The scan advances many text segments in
lockstep, so that each jump is one numpy step for thousands of segments.

Only windows are broadcast, in chunks of at most about `chunk_windows`. A larger benchmark is searched by passes over the texts, one chunk each: a pass writes
what it finds in each distinct text that has hits, under a digest of the text, and its chunk is released before the next one is made. What all passes found
then meets the rows by that digest. No text is shuffled, but where more than MOST_SENT texts have hits of a benchmark of several chunks.

Defined results: null or empty text has no words; repeated rows are searched each on their own; items without id or
without words are not searched; items that share an id count once; an empty benchmark hits nothing. Input columns
named like an output column are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Words, column_bytes, doc_slices, materialize, mix64, spare
from graphloom.plans.tables import discard

SEGMENT = 256
MOST_SENT = 20_000
"""Texts with hits whose hits are broadcast at most, where there are several passes."""
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def split_windows(text: bytes, width: int) -> list[bytes]:
    """The windows of one item, words joined by a space, A-Z lower-cased."""
    raw = np.frombuffer(text, np.uint8)
    w = Words(raw, np.array([0, len(raw)]), "alnum", hashes=False)
    low = text.lower()
    words = [low[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    if not words:
        return []
    k = min(width, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, window) rows, one for each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = column_bytes(b.column(1))
            raw = raw.tobytes()
            ids, found = [], []
            for i, item in enumerate(b.column(0).to_pylist()):
                own = set(split_windows(raw[off[i] : off[i + 1]], width))
                ids += [item] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null")
    return rows.mapInArrow(run, "item string, window binary").distinct()


class WindowSet:
    """Shift table and buckets for windows of one length."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.text = [w for w, _ in windows]
        self.items = [i for _, i in windows]
        joined = b" ".join(self.text)
        raw = np.frombuffer(joined, np.uint8)
        words = Words(raw, np.array([0, len(raw)]), "alnum").hash
        self.m = len(self.text[0].split(b" "))
        grid = words.reshape(len(windows), self.m)
        self.bits = max(12, min(22, int(len(windows) * self.m * 8).bit_length()))
        self.block = 2 if self.m > 1 else 1
        far = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, far, np.uint8 if far < 256 else np.int32)
        for q in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._slot(self._key(grid[:, q], grid[:, q - 1] if self.block > 1 else None)), self.m - 1 - q)
        last = self._key(grid[:, -1], grid[:, -2] if self.block > 1 else None)
        order = np.argsort(last, kind="stable")
        self.suffix, self.order, self.grid = last[order], order, grid[order]

    def _key(self, word: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        return word if before is None else mix64(word + before * np.uint64(0xD6E8FEB86659FD93))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every place where a window's words stand in h."""
        n = len(h)
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.arange(self.m - 1, n, SEGMENT, dtype=np.int64)
        limit = np.minimum(pos + SEGMENT, n)
        found = []
        while len(pos):
            key = self._key(h[pos], h[pos - 1] if self.block > 1 else None)
            jump = self.shift[self._slot(key)].astype(np.int64)
            zero = jump == 0
            if zero.any():
                at, k = pos[zero], key[zero]
                lo, hi = np.searchsorted(self.suffix, k, "left"), np.searchsorted(self.suffix, k, "right")
                some = hi > lo
                if some.any():
                    at, lo, hi = at[some], lo[some], hi[some]
                    reps = hi - lo
                    which = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    end = np.repeat(at, reps)
                    same = np.ones(len(end), bool)
                    for q in range(self.m):
                        same &= h[end - self.m + 1 + q] == self.grid[which, q]
                    found.append((end[same] - self.m + 1, self.order[which[same]]))
            pos = pos + np.maximum(jump, 1)
            go = pos < limit
            pos, limit = pos[go], limit[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f for f, _ in found]), np.concatenate([w for _, w in found])


def build_sets(rows: list[tuple[str, bytes]]) -> list[WindowSet]:
    by: dict[int, dict[bytes, list[str]]] = {}
    for item, w in rows:
        by.setdefault(w.count(b" ") + 1, {}).setdefault(w, []).append(item)
    return [WindowSet(sorted(by[k].items())) for k in sorted(by)]


def find_occurrences(raw: np.ndarray, off: np.ndarray, sets: list[WindowSet]) -> Iterator[tuple[int, int, list, list]]:
    """For each document: number of words, merged hit ranges of words, and the items hit."""
    for a, b in doc_slices(off):
        own, o = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        w = Words(own, o, "alnum")
        low = None
        starts, ends, docs, hits = [], [], [], [[] for _ in range(b - a)]
        for s in sets:
            first, which = s.search(w.hash)
            if not len(first):
                continue
            low = own.tobytes().lower() if low is None else low
            doc = np.searchsorted(w.first, first, "right") - 1
            inside = first + s.m <= w.first[doc + 1]
            for f, k, d in zip(first[inside].tolist(), which[inside].tolist(), doc[inside].tolist(), strict=True):
                at, to = w.start[f : f + s.m].tolist(), w.end[f : f + s.m].tolist()
                if b" ".join([low[x:y] for x, y in zip(at, to, strict=True)]) == s.text[k]:
                    starts.append(f)
                    ends.append(f + s.m)
                    hits[d].append((s, k))
        if starts:
            cover = np.zeros(len(w.start) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, ends, -1)
            cover = np.cumsum(cover)[:-1] > 0
        for d in range(b - a):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            if not hits[d]:
                yield hi - lo, [], []
                continue
            c = np.diff(np.concatenate(([0], cover[lo:hi].astype(np.int8), [0])))
            spans = list(zip(np.flatnonzero(c == 1).tolist(), np.flatnonzero(c == -1).tolist(), strict=True))
            yield hi - lo, spans, sorted({i for s, k in set(hits[d]) for i in s.items[k]})


def _search(docs: DataFrame, sent, at: int, columns: list[str], schema: T.StructType, hit_only: bool) -> DataFrame:
    """The columns with n_words, hits and items of the broadcast sets; hit_only: rows with hits alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at)
            raw, off = column_bytes(text.cast(pa.string()) if not pa.types.is_string(text.type) else text)
            n, spans, items = [], [], []
            for words, hit, found in find_occurrences(raw, off, sent.value):
                n.append(words)
                spans.append([{"start": s, "end": e} for s, e in hit])
                items.append(found)
            arrays = [b.column(c) for c in columns] + [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(arrays, schema.names)
            yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if hit_only else out

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 8, chunk_windows: int = 200_000) -> DataFrame:
    """Adds n_words, hits (ranges of words inside occurrences, end exclusive), items (ids as strings) and n_hit."""
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, item_id, item_text, width), "windows")
    chunks = max(1, -(-windows.count() // chunk_windows))
    docs = docs.drop("n_words", "n_hit", "hits", "items")
    found = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))]
    chunk = lambda c: spark.sparkContext.broadcast(build_sets([(r.item, bytes(r.window)) for r in (windows.filter(F.pmod(F.xxhash64("window"), F.lit(chunks)) == c) if chunks > 1 else windows).collect()]))
    if chunks == 1:
        out = _search(docs, chunk(0), docs.columns.index(text_col), docs.columns, T.StructType([*docs.schema.fields, *found]), False)
        discard(windows)
        return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))
    (c_key,) = spare(docs.columns, "text_key")
    key = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))).alias(c_key)
    texts = docs.filter(F.col(text_col).isNotNull()).select(key, F.col(text_col).cast("string").alias("text"))
    passes = []
    for c in range(chunks):
        sent = chunk(c)
        own = _search(texts, sent, 1, [c_key], T.StructType([T.StructField(c_key, T.BinaryType()), *found]), True)
        # Copies of a text have the same hits.
        passes.append(materialize(own.groupBy(c_key).agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "window-hits"))
        sent.destroy()
    merged = reduce(DataFrame.unionByName, passes).groupBy(c_key).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = materialize(merged, "window-hits")
    discard(windows, *passes)
    if merged.count() <= MOST_SENT:
        merged = F.broadcast(merged)
    counted = _search(docs, spark.sparkContext.broadcast([]), docs.columns.index(text_col), docs.columns, T.StructType([*docs.schema.fields, *found]), False).drop("hits", "items")
    out = counted.withColumn(c_key, F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))).join(merged, c_key, "left")
    out = out.select(*docs.columns, "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["end"] - 1)))))
    return out.withColumn("n_hit", covered.cast("long"))
