"""Exact top-k inner products with M-trees.

Every vector is quantised to integers, floor(scale * x). With one more component, sqrt(M^2 - |x|^2), where M is the
largest norm of all, all objects lie on a sphere, so that the nearest object of a query (whose extra component is 0)
is the one of largest inner product; Euclidean distance is the trees' metric and the integer inner product the score.

The topmost page is the same for all: at most `most_cells` routing objects, rows drawn by a hash (the bound), with the covering radius of the rows
that are nearest to each. A cell's rows are dealt over trees of about `tree_rows` rows by a hash of their place, so that no vector, however often it is
repeated, makes a large tree. A tree is bulk loaded: a page keeps its entries' vectors (routing or ground objects),
covering radii and distances to the page's own routing object. A query descends best first: a queue of pages by their
least possible distance; an entry is looked at only if the difference of two stored or known distances, less its radius,
is not beyond the k-th best found; the search ends when the nearest page left is beyond it. The queries of a block go down together, a matrix product a page. Bounds carry a small
margin for rounding, scores are exact integers (of 64 bits).

A query first searches one tree of its nearest cell. The k-th best found there bounds all else: the query goes on only to the trees of cells whose least possible
distance is not beyond it, and takes the bound along. Queries travel to trees, in blocks of about `block_queries`; a tree is read once for each round and unpacked once a run of blocks.
Only k rows a query and tree are shuffled on. How many trees a query meets depends on the vectors: few where they lie in groups, all where no routing object is nearer than others.

Defined results: a vector that is null, empty or has a null or non-finite component takes no part, neither does one
without id; vectors of different length are not compared; an empty table gives no rows; rows that share the query's id
are its own row; equal scores go to the smaller id. A row is a row: an id that stands in n rows can hold n ranks, and a query id
that stands in several rows has the best k hits of all of them, as in the query's SQL.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, shuffle_width

PAGE = 256
"""Most entries of a leaf page; an inner page has as many children."""
CELL_ROWS = 8192
"""Rows of a cell, about, while there are fewer than the most cells."""
EXACT = 1 << 24
"""Whole numbers below this are exact in 32 bits."""
NONE = -(1 << 62)
"""Below all scores."""
WHOLE = 1 << 53
"""Squared norms below this, and so all scores, are exact in doubles; beyond, vectors are kept as 64-bit integers."""


@dataclass
class Page:
    """rows: numbers of ground objects (leaf), else None. vec: of the entries; to_parent: their distance to this page's routing object."""

    vec: np.ndarray
    to_parent: np.ndarray
    rows: np.ndarray | None = None
    radius: np.ndarray | None = None
    children: list[Page] = field(default_factory=list)


def margin_of(qq: float, top: float) -> float:
    """For rounding, of distances between a query of squared norm qq and objects of squared norm top."""
    return 1e-9 * (1.0 + np.sqrt(qq) + np.sqrt(top))


def reach_of(qq: float, top: float, score: float) -> float:
    """Distance of an object of this score."""
    return float(np.sqrt(max(qq + top - 2 * score, 0.0)))


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, seed: int = 1):
        """top: the largest squared norm of all vectors, of this tree or others."""
        self.ids = ids
        norm = (vectors * vectors).sum(1)
        self.top = top
        if top >= WHOLE:
            vectors = vectors.astype(np.int64)
        self.x = vectors
        self.aux = np.sqrt(np.maximum(self.top - norm, 0.0))
        self.kind = vectors.dtype
        self.stored = np.float32 if len(vectors) and np.abs(vectors).max() < EXACT else self.kind
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), None)
        # The pages have the vectors now.
        del self.rng, self.x, self.aux

    def _far(self, rows: np.ndarray, v: np.ndarray, a: float) -> np.ndarray:
        """Distances of objects to the object (v, a)."""
        return np.sqrt(np.maximum(2 * self.top - 2 * (self.x[rows] @ v + self.aux[rows] * a), 0.0))

    def _build(self, rows: np.ndarray, parent: tuple[np.ndarray, float] | None) -> Page:
        away = lambda r: np.zeros(len(r)) if parent is None else self._far(r, *parent)
        if len(rows) <= PAGE:
            return Page(self.x[rows].astype(self.stored), away(rows), rows=rows)
        k = min(PAGE, -(-len(rows) // (PAGE // 2)))
        routers = self.rng.choice(rows, k, replace=False)
        close = self.x[rows] @ self.x[routers].T + np.outer(self.aux[rows], self.aux[routers])
        nearest = close.argmax(1)
        if np.bincount(nearest, minlength=k).max() > 0.9 * len(rows):  # copies: any split will do
            nearest = np.arange(len(rows)) % k
        parts = [(r, rows[nearest == i]) for i, r in enumerate(routers) if (nearest == i).any()]
        routers = np.array([r for r, _ in parts])
        children = [self._build(own, (self.x[r], self.aux[r])) for r, own in parts]
        radius = np.array([self._far(own, self.x[r], self.aux[r]).max() for r, own in parts])
        return Page(self.x[routers].astype(self.stored), away(routers), radius=radius, children=children)

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query (own id, least score asked for) the (score, id) of the k best objects but its own that score `least` at least, best first.

        The queries of a block go down together: a page is taken by the least distance that it may have from any of them, and looked at for those that it may still serve.
        """
        q = q.astype(self.kind)
        qq = (q * q).sum(1).astype(np.float64)
        margin = 1e-9 * (1.0 + np.sqrt(qq) + np.sqrt(self.top))
        reach = np.where(np.isfinite(least), np.sqrt(np.maximum(qq + self.top - 2 * np.where(np.isfinite(least), least, 0.0), 0.0)), np.inf) + margin
        best_score, best_id = np.full((len(q), k), NONE, np.int64), np.full((len(q), k), -NONE, np.int64)
        queue: list[tuple[float, int, Page, np.ndarray | None, np.ndarray]] = [(0.0, 0, self.root, None, np.zeros(len(q)))]
        made = 1
        while queue:
            bound, _, page, d_parent, low = heapq.heappop(queue)
            if bound > reach.max():
                break
            on = np.flatnonzero(low <= reach)
            if not len(on):
                continue
            far = reach[on][:, None]
            need = np.ones((len(on), len(page.to_parent)), bool)
            if d_parent is not None:
                # Entries that the triangle inequality rules out for all are not looked at.
                need = np.abs(d_parent[on][:, None] - page.to_parent) - (0.0 if page.radius is None else page.radius) <= far
            some = np.flatnonzero(need.any(0))
            if not len(some):
                continue
            need = need[:, some]
            score = q[on] @ page.vec[some].astype(self.kind).T
            if page.rows is None:
                d = np.sqrt(np.maximum(qq[on][:, None] + self.top - 2.0 * score, 0.0))
                lows = np.where(need, np.maximum(d - page.radius[some], 0.0), np.inf)
                lows[lows > far] = np.inf
                for j in np.flatnonzero(np.isfinite(lows).any(0)).tolist():
                    child_low, child_d = np.full(len(q), np.inf), np.zeros(len(q))
                    child_low[on], child_d[on] = lows[:, j], d[:, j]
                    heapq.heappush(queue, (float(lows[:, j].min()), made, page.children[some[j]], child_d, child_low))
                    made += 1
                continue
            ids = self.ids[page.rows[some]]
            good = need & (ids != own[on][:, None]) & (score >= least[on][:, None]) & (score >= best_score[on, -1][:, None])
            for r in np.flatnonzero(good.any(1)).tolist():
                i = on[r]
                s, n = np.append(best_score[i], score[r, good[r]].astype(np.int64)), np.append(best_id[i], ids[good[r]])
                order = np.lexsort((n, -s))[:k]
                best_score[i], best_id[i] = s[order], n[order]
                if best_score[i, -1] > NONE:
                    reach[i] = np.sqrt(max(qq[i] + self.top - 2.0 * best_score[i, -1], 0.0)) + margin[i]
        return [[(s, n) for s, n in zip(x, y, strict=True) if s > NONE] for x, y in zip(best_score.tolist(), best_id.tolist(), strict=True)]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in 32 bits where that is exact, else in 64."""
    return (x.astype(np.float32) if len(x) and np.abs(x).max() < EXACT else x).tobytes()


def unpacked(blob: bytes, length: int) -> np.ndarray:
    return np.frombuffer(blob, np.float32 if len(blob) == 4 * length else np.float64).astype(np.float64)


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(key, id, q, length, norm, x): the rows (key, id, vector, q) that take part, as whole numbers; norm is squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, length, norm, out = [], [], [], []
            for i, (own, v) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                if not own.is_valid or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(scale * x)
                    take.append(i)
                    length.append(len(x))
                    norm.append(float(x @ x))
                    out.append(packed(x))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(length, pa.int32()), pa.array(norm, pa.float64()), pa.array(out, pa.binary())], ["key", "id", "q", "length", "norm", "x"])

    return rows.mapInArrow(run, "key long, id long, q boolean, length int, norm double, x binary")


@dataclass
class Cells:
    """The topmost page, for vectors of one length: routing objects and, later, their covering radii and numbers of trees."""

    top: float
    x: np.ndarray
    aux: np.ndarray
    radius: np.ndarray | None = None
    trees: np.ndarray | None = None

    def nearest(self, x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its routing object) of each object."""
        close = x @ self.x.T + np.outer(np.sqrt(np.maximum(self.top - norm, 0.0)), self.aux)
        cell = close.argmax(1)
        return cell, np.sqrt(np.maximum(2 * self.top - 2 * close[np.arange(len(x)), cell], 0.0))

    def away(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to all routing objects."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.top - 2 * (q @ self.x.T), 0.0))


def _by_length(b: pa.RecordBatch, length: int, x: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch's columns."""
    sizes = b.column(length).to_numpy()
    blobs = b.column(x)
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        yield n, own, np.stack([unpacked(blobs[i].as_py(), n) for i in own.tolist()])


def _routing(rows: DataFrame, most_cells: int, a_cell: int) -> dict[int, Cells]:
    """Routing objects by length: rows of the least hashes, one of each vector."""
    about = {r["length"]: (r["n"], r["top"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}
    total = sum(n for n, _ in about.values())
    wanted = min(most_cells, max(1, total // a_cell))
    place = F.pmod(F.xxhash64("x"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(place < 4 * wanted / max(1, total)).select("length", "x").distinct().orderBy(F.xxhash64("x", F.lit(1))).limit(wanted).collect() if wanted > 1 else []
    out = {}
    for n, (_, top) in about.items():
        own = np.array([unpacked(bytes(r["x"]), n) for r in drawn if r["length"] == n]).reshape(-1, n)
        x = own if len(own) else np.zeros((1, n))
        out[n] = Cells(top, x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0)))
    return out


def _celled(rows: DataFrame, cells) -> DataFrame:
    """Adds cell and far, the distance to its routing object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            norm = b.column(4).to_numpy()
            for n, own, x in _by_length(b, 3, 5):
                cell[own], far[own] = cells.value[n].nearest(x, norm[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*b.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "key long, id long, q boolean, length int, norm double, x binary, cell int, far double")


def _trees(rows: DataFrame, cells) -> DataFrame:
    """(length, cell, tree, blob) of rows (id, length, x, cell, tree)."""

    def run(table: pa.Table) -> pa.Table:
        n, cell, tree = (table.column(c)[0].as_py() for c in ("length", "cell", "tree"))
        x = np.stack([unpacked(v.as_py(), n) for v in table.column("x")])
        made = MTree(table.column("id").to_numpy(), x, cells.value[n].top)
        return pa.table({"length": pa.array([n], pa.int32()), "cell": pa.array([cell], pa.int32()), "tree": pa.array([tree], pa.int32()), "blob": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    return rows.groupBy("length", "cell", "tree").applyInArrow(run, "length int, cell int, tree int, blob binary")


def _searched(asks: DataFrame, trees: DataFrame, k: int, blocks: int) -> DataFrame:
    """(key, query_id, id, score): the k best of each ask (length, cell, tree, key, id, x, least) in its tree."""
    key = ["length", "cell", "tree"]
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    lists = asks.groupBy(*key, block).agg(F.collect_list(F.struct("key", "id", "x", "least")).alias("asks"))
    # A search is work, not bytes: AQE would put many into one task by their size.
    met = lists.join(trees.hint("merge"), key).select(F.concat_ws("/", *key).alias("name"), "blob", "asks", "length", "block").repartition(shuffle_width(asks.sparkSession), "name", "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, None
        for b in batches:
            for own, blob, asked, n in zip(*b.columns, strict=True):
                if own.as_py() != name:
                    name, tree = own.as_py(), pickle.loads(blob.as_py())
                asked = asked.as_py()
                got = tree.nearest(np.stack([unpacked(a["x"], n.as_py()) for a in asked]), np.array([a["id"] for a in asked], np.int64), k, np.array([a["least"] for a in asked], float))
                found = [(a["key"], a["id"], i, s) for a, own in zip(asked, got, strict=True) for s, i in own]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["key", "query_id", "id", "score"])

    return met.mapInArrow(run, "key long, query_id long, id long, score long")


def _onward(asks: DataFrame, cells) -> DataFrame:
    """(length, cell, tree, key, id, x, least) for every tree that may hold an object as good as `least`, but the one searched (cell, tree) of asks (key, id, length, x, cell, tree, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, blobs, least = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), b.column(6).to_numpy()
            home, tree = b.column(4).to_numpy(), b.column(5).to_numpy()
            for n, own, x in _by_length(b, 2, 3):
                c: Cells = cells.value[n]
                low = c.away(x) - c.radius[None, :]
                for j, i in enumerate(own.tolist()):
                    qq = float(x[j] @ x[j])
                    near = np.flatnonzero(low[j] <= reach_of(qq, c.top, least[i]) + margin_of(qq, c.top))
                    at = [(int(m), t) for m in near.tolist() for t in range(int(c.trees[m])) if (m, t) != (home[i], tree[i])]
                    if at:
                        m = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([n] * m, pa.int32()), pa.array([a for a, _ in at], pa.int32()), pa.array([t for _, t in at], pa.int32()), pa.array([int(keys[i])] * m, pa.int64()), pa.array([int(ids[i])] * m, pa.int64()), pa.array([blobs[i].as_py()] * m, pa.binary()), pa.array([float(least[i])] * m, pa.float64())],
                            ["length", "cell", "tree", "key", "id", "x", "least"],
                        )

    return asks.mapInArrow(run, "length int, cell int, tree int, key long, id long, x binary, least double")


def top_inner_products(vectors: DataFrame, id_col: str, vector_col: str, is_query, k: int = 5, scale: float = 256.0, tree_rows: int = 8192, block_queries: int = 1024, most_cells: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k rows of largest inner product for every row that satisfies is_query (a column)."""
    sc = vectors.sparkSession.sparkContext
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    whole = materialize(quantised(rows, scale), "vectors")
    cells = _routing(whole, most_cells, min(CELL_ROWS, tree_rows))
    celled = materialize(_celled(whole, sc.broadcast(cells)), "cells")
    for c in cells.values():
        c.radius, c.trees = np.zeros(len(c.x)), np.zeros(len(c.x), np.int64)
    asked = 0
    for r in celled.groupBy("length", "cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).collect():
        c = cells[r["length"]]
        c.radius[r["cell"]], c.trees[r["cell"]] = r["radius"], -(-r["n"] // tree_rows)
        asked += r["asked"]
    sent, blocks = sc.broadcast(cells), max(1, -(-asked // block_queries))
    number = vectors.sparkSession.createDataFrame([(n, m, int(t)) for n, c in cells.items() for m, t in enumerate(c.trees)] or [(0, 0, 0)], "length int, cell int, trees int")
    # At most most_cells rows a length.
    dealt = celled.join(F.broadcast(number), ["length", "cell"]).withColumn("tree", F.pmod(F.xxhash64("key"), "trees").cast("int"))
    trees = materialize(_trees(dealt.select("id", "length", "x", "cell", "tree"), sent), "mtree")
    home = materialize(_homes(celled.filter("q").select("key", "id", "length", "x"), sent), "asks")
    first = materialize(_searched(home, trees, k, blocks), "hits")
    worst = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).select("key", "score")
    asks = home.drop("least").join(worst.hint("merge"), "key", "left").select("key", "id", "length", "x", "cell", "tree", F.coalesce(F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 4e-16, F.lit(float("-inf"))).alias("least"))
    best = first.unionByName(_searched(_onward(asks, sent), trees, k, blocks))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _homes(queries: DataFrame, cells) -> DataFrame:
    """Adds cell, tree and least to queries (key, id, length, x): one tree of the cell whose routing object is nearest to the query, which has no least score yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, tree = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            key = b.column(0).to_numpy()
            for n, own, x in _by_length(b, 2, 3):
                c: Cells = cells.value[n]
                cell[own] = np.where(c.trees > 0, c.away(x), np.inf).argmin(1)
                tree[own] = key[own] % c.trees[cell[own]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(tree, pa.int32()), pa.array(np.full(b.num_rows, -np.inf), pa.float64())], [*b.schema.names, "cell", "tree", "least"])

    return queries.mapInArrow(run, "key long, id long, length int, x binary, cell int, tree int, least double")
