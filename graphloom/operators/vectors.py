"""Exact vector search, mutual neighbours, clustering and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.tables import materialize

BLOCK_ROWS = 1 << 16
"""Rows of a block at most: 17 MB of 64 numbers of 32 bits."""
LEAST_ROWS = 2048
CELL_ROWS = 1 << 14
STEP_ROWS = 1024
MOST_PAIRS = 1 << 16
MOST_SENT = 1 << 22
"""Numbers of centres that are broadcast at most, 8 bytes each."""
DEALT_ROWS = 1 << 13
MOST_DEALT = 1 << 18
"""Rows that a task of k-means goes through at most: 67 MB of 64 numbers of 32 bits."""
MOST_MERGED = 1 << 26
"""Bytes of sums that a task of k-means adds up, about."""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_share(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1."""
    return (dot(a, b) / (norm(a) * norm(b)) + 1) / 2


def _true(found: np.ndarray) -> np.ndarray:
    """flatnonzero where few are true: by eight at a time."""
    flat = found.ravel()
    whole = len(flat) - len(flat) % 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    word, place = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[word] * 8 + place, np.flatnonzero(flat[whole:]) + whole])


def best_rows(q: np.ndarray, x: np.ndarray, k: int, q_name: np.ndarray | None = None, x_name: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, product): the k rows of x of largest inner product with each row of q, by nine decimals, ties to the earlier row; none that has the query's own name.

    Exact: products in 32 bits and the bound of their error tell which pairs can be among the best; those are computed in 64 bits. Rows of x come in steps: a later row that
    equals the k-th so far can't replace it, so that copies cost no more than their product. The first rows' products in 32 bits say from the start what can't be among the best.
    """
    ahead = min(len(x), 4 * STEP_ROWS)
    ahead = ahead if k + 1 < ahead and (x_name is None or len(np.unique(x_name)) == len(x)) else 0
    x32, longest = x.astype(np.float32), float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0.0)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for top in range(0, len(q), STEP_ROWS):
        own = q[top : top + STEP_ROWS].astype(float)
        n, own32 = len(own), own.astype(np.float32)
        wide = (q.shape[1] + 4) * 2.0**-24 * 1.01 * longest * np.sqrt((own**2).sum(axis=1)) + 2e-9
        least = np.full(n, -np.inf)
        if ahead:
            # One of these may be the query itself.
            sure = np.partition(np.fmax(own32 @ x32[:ahead].T, -np.inf), -k - 1, axis=1)[:, -k - 1] - wide
            least = np.where(np.isfinite(sure), sure, -np.inf)
        best = new = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        at, size = 0, max(32, 2 * k)
        while at < len(x):
            end = min(len(x), at + size)
            hit = _true(own32 @ x32[at:end].T >= (least - wide).astype(np.float32)[:, None])
            r, c = hit // (end - at), hit % (end - at) + at
            at, size = end, min(end, 2 * STEP_ROWS)
            for part in range(0, len(r), MOST_PAIRS):
                i, j = r[part : part + MOST_PAIRS], c[part : part + MOST_PAIRS]
                if q_name is not None:
                    other = q_name[top + i] != x_name[j]
                    i, j = i[other], j[other]
                s = np.einsum("ij,ij->i", own[i], x[j].astype(float))
                more = np.round(s, 9) > least[i]
                new = tuple(np.concatenate(both) for both in zip(new, (i[more], j[more], s[more]), strict=True))
            if len(new[0]) < n * k and at < len(x):
                continue
            i, j, s = (np.concatenate(both) for both in zip(best, new, strict=True))
            order = np.lexsort((j, -np.round(s, 9), i))
            i = i[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            order, i, place = order[place < k], i[place < k], place[place < k]
            best, new = (i, j[order], s[order]), tuple(b[:0] for b in new)
            full = place == k - 1
            least[i[full]] = np.round(best[2][full], 9)
        found.append((best[0] + top, best[1], best[2]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(rows: pa.Table) -> np.ndarray:
    v = rows.column("v").combine_chunks()
    if v.null_count:
        raise ValueError("a row has no vector")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _keyed(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(k, v): vectors in 32 bits stay so."""
    kind = rows.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(vector).cast("array<double>")
    return rows.select(*more, F.col(key).alias("k"), v.alias("v"))


def _best(queries: DataFrame, items: DataFrame, gq: Column, gi: Column, k: int, drop_self: bool, *within: str) -> DataFrame:
    """(q, i, sim, rank) of queries and items (k, v) of the same group (within), which come as gq and gi blocks: a task has a block of each and lets k rows a query go on; ties to the smaller item."""
    kq, ki = queries.schema["k"].dataType, items.schema["k"].dataType
    key = [*within, "qb", "ib"]
    block = lambda n: F.pmod(F.xxhash64("k"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    a = queries.select(*within, "k", "v", block(gq).alias("qb"), each(gi).alias("ib"))
    b = items.select(*within, "k", "v", block(gi).alias("ib"), each(gq).alias("qb"))

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        qk, ik = asked.column("k").combine_chunks(), there.column("k").combine_chunks()
        if not len(qk) or not len(ik):
            return pa.table([qk[:0], ik[:0], pa.array([], pa.float64())], ["q", "i", "sim"])
        parts = ik.flatten() if pa.types.is_struct(ik.type) else [ik]
        names = [str(n) for n in range(len(parts))]
        order = pc.sort_indices(pa.table(parts, names), sort_keys=[(n, "ascending") for n in names])
        ik, x = ik.take(order), _matrix(there)[order.to_numpy()]
        named = (None, None)
        if drop_self:
            own = pc.unique(ik)
            named = tuple(pc.fill_null(pc.index_in(keys, own), -1).to_numpy(zero_copy_only=False) for keys in (qk, ik))
        rows, found, sim = best_rows(_matrix(asked), x, k, *named)
        return pa.table([qk.take(pa.array(rows)), ik.take(pa.array(found)), pa.array(sim)], ["q", "i", "sim"])

    best = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(run, T.StructType([T.StructField("q", kq), T.StructField("i", ki), T.StructField("sim", T.DoubleType())]))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.round("sim", 9).desc(), "i"))).filter(F.col("rank") <= k)


def _grid(queries: int, items: int, tasks: int) -> tuple[int, int]:
    """Numbers of blocks of either side: BLOCK_ROWS at most in each; more where that leaves fewer pairs of blocks than `tasks` and blocks are large."""
    gq, gi = max(1, -(-queries // BLOCK_ROWS)), max(1, -(-items // BLOCK_ROWS))
    while gq * gi < tasks and max(queries / gq, items / gi) > LEAST_ROWS:
        gq, gi = (gq + 1, gi) if queries / gq >= items / gi else (gq, gi + 1)
    return gq, gi


def top_k(queries: DataFrame, items: DataFrame, k: int, q_key: str = "qid", i_key: str = "id", vector: str = "embedding", drop_self: bool = False) -> DataFrame:
    """(q_key, i_key, sim, rank): the k items of largest inner product; ties to the smaller item.

    Exact: blocks of queries meet blocks of items. Neither side is broadcast or gathered; each side is sent once for every block of the other. The number of products is that
    of the work, which grows with both tables. `probed_top_k` is the form for large ones.
    """
    gq, gi = _grid(queries.count(), items.count(), 2 * queries.sparkSession.sparkContext.defaultParallelism)
    best = _best(_keyed(queries, q_key, vector), _keyed(items, i_key, vector), F.lit(gq), F.lit(gi), k, drop_self)
    return best.select(F.col("q").alias(q_key), F.col("i").alias(i_key), "sim", "rank")


def probed_top_k(queries: DataFrame, items: DataFrame, k: int, q_key: str = "qid", i_key: str = "id", vector: str = "embedding", drop_self: bool = False, cells: int | None = None, probes: int | None = None, most_centres: int = 1024) -> DataFrame:
    """(q_key, i_key, sim, rank): top_k among the items of the cells whose centres are nearest to the query; approximate in what it looks at, exact in how it ranks.

    The centres are items drawn by a hash, `cells` of them (the root of the items unless stated, most_centres at most: the bound of what the driver holds); every
    item lies in the cell of its nearest centre, and a query looks into `probes` of them, a quarter unless stated. A cell of many rows is dealt to several tasks.
    """
    n = items.count()
    cells = cells or max(1, min(most_centres, int(n**0.5)))
    place = F.pmod(F.xxhash64(i_key, F.lit("centre")), F.lit(1 << 40)) / float(1 << 40)
    centres = items.filter(place < 4 * cells / max(1, n)).orderBy(place, i_key).limit(cells).select(F.monotonically_increasing_id().alias("cell"), F.col(vector).alias("centre"))
    centres = materialize(centres, "centres")
    probes = probes or max(1, -(-centres.count() // 4))
    near = lambda rows, key, most: materialize(nearest_centres(rows, centres, most, key, vector, "cell", "centre").select(F.col(key).alias("k"), F.col("cell").alias("c")), "cells")
    placed, looked = near(items, i_key, 1), near(queries, q_key, probes)
    blocks = lambda rows, name: rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias(name))
    sizes = blocks(placed, "gi").join(blocks(looked, "gq"), "c")
    met = [_keyed(rows, key, vector).join(dealt, "k").join(sizes, "c") for rows, key, dealt in ((queries, q_key, looked), (items, i_key, placed))]
    best = _best(*met, F.col("gq"), F.col("gi"), k, drop_self, "c")
    return best.select(F.col("q").alias(q_key), F.col("i").alias(i_key), "sim", "rank")


def node_top_k(queries: DataFrame, vectors: DataFrame, k: int, q_key: str = "qid", vector: str = "embedding", fold: bool = False) -> DataFrame:
    """(q_key, node_id, ord, sim, rank): top_k over nodes that have several vectors (node_id, ord). A node can hold several ranks; with fold only its best one, and ranks close up."""
    items = vectors.withColumn("_i", F.struct("node_id", "ord"))
    if not fold:
        found = top_k(queries, items, k, q_key, "_i", vector)
        return found.select(q_key, "_i.node_id", "_i.ord", "sim", "rank")
    most = vectors.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    found = top_k(queries, items, k * most, q_key, "_i", vector)
    first = found.groupBy(q_key, F.col("_i.node_id").alias("node_id")).agg(F.min(F.struct("rank", "sim", "_i.ord")).alias("b")).select(q_key, "node_id", "b.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(q_key).orderBy("rank"))).filter(F.col("rank") <= k).select(q_key, "node_id", "ord", "sim", "rank")


def self_neighbours(vectors: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(src, dst, sim, rank): the k nearest others of every row."""
    found = top_k(vectors.withColumnRenamed(key, "src"), vectors.withColumnRenamed(key, "dst"), k, "src", "dst", vector, drop_self=True)
    return found.select("src", "dst", "sim", "rank")


def mutual_edges(neighbours: DataFrame, least: float) -> DataFrame:
    """(src, dst, sim), src < dst, where each is among the other's neighbours and sim > least."""
    back = neighbours.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return neighbours.filter((F.col("src") < F.col("dst")) & (F.col("sim") > least)).join(back, ["src", "dst"], "left_semi").select("src", "dst", "sim")


def nearest_centres(vectors: DataFrame, centres: DataFrame, k: int, key: str = "id", vector: str = "embedding", c_key: str = "cluster", c_vector: str = "centre") -> DataFrame:
    """(key, c_key, rank): the k centres (c_key, c_vector) of largest inner product, ties to the smaller one. As one broadcast matrix while they have MOST_SENT numbers at most, else by blocks."""
    about = centres.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(c_vector)).alias("size")).first()
    if (about["size"] or 0) > MOST_SENT:
        return top_k(vectors, centres.withColumnRenamed(c_vector, vector), k, key, c_key, vector).select(key, c_key, "rank")
    rows = centres.orderBy(c_key).select(c_key, F.col(c_vector).cast("array<double>").alias("v")).toArrow()
    names = rows.column(c_key).to_pylist()
    sent = vectors.sparkSession.sparkContext.broadcast((names, np.array(rows.column("v").to_pylist(), float).reshape(len(names), -1)))
    kv, kc = vectors.schema[key].dataType, centres.schema[c_key].dataType
    c_type = rows.schema.field(c_key).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = sent.value
        take = min(k, len(own))
        for b in batches:
            if not b.num_rows or not take:
                continue
            far = np.round(-(np.stack(b.column(1).to_numpy(zero_copy_only=False)) @ x.T), 9)
            near = np.argsort(far, axis=1, kind="stable")[:, :take].ravel().tolist()
            at = pa.array(np.repeat(np.arange(b.num_rows), take))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([own[i] for i in near], c_type), pa.array(np.tile(np.arange(1, take + 1), b.num_rows), pa.int32())], [key, c_key, "rank"])

    return vectors.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, T.StructType([T.StructField(key, kv), T.StructField(c_key, kc), T.StructField("rank", T.IntegerType())]))


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c of largest product with each row of x by twelve decimals, ties to the earlier; all rows have length one.

    Products in 32 bits settle all rows but those whose two best lie within the bound of their error; these are computed in 64 bits.
    """
    x32, c32 = x.astype(np.float32), c.astype(np.float32)
    wide = 2 * (x.shape[1] + 4) * 2.0**-24 * 1.01 + 1e-11
    best = np.empty(len(x), np.int64)
    for top in range(0, len(x), STEP_ROWS):
        s = x32[top : top + STEP_ROWS] @ c32.T
        rows, first = np.arange(len(s)), s.argmax(axis=1)
        most = s[rows, first]
        s[rows, first] = -np.inf
        open_ = np.flatnonzero(most - s.max(axis=1) <= wide)
        first[open_] = np.round(x[top + open_] @ c.T, 12).argmax(axis=1)
        best[top : top + STEP_ROWS] = first
    return best


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _summed(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one name added up, by name."""
    order = np.argsort(names, kind="stable")
    own, at = np.unique(names[order], return_index=True)
    return own, np.add.reduceat(rows[order], at) if len(own) else rows


def _settled(vectors: DataFrame, vector: str, n: int, centres: np.ndarray, rounds: int, least: float) -> np.ndarray:
    """Centres after rounds of k-means by cosine: until none moves by more than `least`. Those without rows stay.

    Vectors are dealt once to a task a core and kept as blocks. In a round each task adds up its rows by their centre, and what the tasks found is added up on the executors; only
    centres that moved come to the driver. Sums are whole numbers: they don't depend on how rows are dealt, so that a centre whose rows stay doesn't move.
    """
    sc, dim = vectors.sparkSession.sparkContext, centres.shape[1]
    tasks = max(-(-n // MOST_DEALT), min(sc.defaultParallelism, -(-n // LEAST_ROWS)))
    shards = -(-centres.size * 8 * tasks // MOST_MERGED)
    scale = 2.0 ** min(40, 62 - n.bit_length())
    kind = np.float32 if vectors.schema[vector].dataType.elementType == T.FloatType() else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([np.concatenate(kept).tobytes()], pa.binary())], ["block"])
        for b in batches:
            kept += [_matrix(pa.table(b))] if b.num_rows else []
            if sum(map(len, kept)) >= DEALT_ROWS:
                yield whole()
                kept = []
        if kept:
            yield whole()

    blocks = _keyed(vectors, vector, vector).select("v").repartition(tasks).mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(rounds):
            sent = sc.broadcast(centres)

            def add(own: Iterator[bytes], sent=sent) -> Iterator[tuple]:
                found = []
                for block in own:
                    x = _units(np.frombuffer(block, kind).reshape(-1, dim))
                    found.append(_summed(closest(x, sent.value), np.rint(x * scale).astype(np.int64)))
                if found:
                    names, sums = _summed(*map(np.concatenate, zip(*found, strict=True)))
                    for shard in range(shards):
                        mine = names % shards == shard
                        yield shard, (names[mine], sums[mine])

            def merge(parts: Iterator[tuple], sent=sent) -> Iterator[tuple]:
                found = [part for _, part in parts]
                if found:
                    names, sums = _summed(*map(np.concatenate, zip(*found, strict=True)))
                    # Rows that cancel out leave a centre where it is.
                    names, new = names[sums.any(axis=1)], _units(sums[sums.any(axis=1)])
                    moved = (new != sent.value[names]).any(axis=1)
                    yield names[moved], new[moved]

            found = blocks.mapPartitions(add).partitionBy(shards).mapPartitions(merge).collect()
            far, centres = 0.0, centres.copy()
            for names, new in found:
                far = max(far, (1 - (centres[names] * new).sum(axis=1)).max(initial=0.0))
                centres[names] = new
            sent.destroy()
            if far <= least:
                break
    finally:
        blocks.unpersist()
    return centres


def spherical_kmeans(vectors: DataFrame, key: str = "id", vector: str = "embedding", k: int | None = None, rounds: int = 1000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((key, cluster), centres (cluster, centre)): k is the floor of the root of the rows unless given; k-means by cosine, which ends when the centres rest.

    Spark's k-means chooses the centres that it begins with; its rounds send the driver all centres and the metrics of a task for every file, so that ours follow.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = max(2, int(n**0.5)) if k is None else k
    first = KMeans(k=k, maxIter=0, seed=seed, distanceMeasure="cosine").fit(vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
    found = _settled(vectors, vector, n, _units(np.array(first.clusterCenters())), rounds, first.getTol())
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = closest(_units(_matrix(pa.table(b))), sent.value) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32())], [key, "cluster"])

    own = _keyed(vectors, key, vector).mapInArrow(run, T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType())]))
    return own, vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cluster int, centre array<double>")


def in_clusters(vectors: DataFrame, high: str, key: str = "id", vector: str = "embedding", k: int | None = None, near: int = 3) -> tuple[DataFrame, DataFrame]:
    """((key, cluster), (key, cluster)): rows whose id doesn't match `high` in the cluster that they make, and those that do in the `near` clusters nearest to them."""
    low = vectors.filter(~F.col(key).rlike(high))
    own, centres = spherical_kmeans(low, key, vector, k)
    return own, nearest_centres(vectors.filter(F.col(key).rlike(high)), centres, near, key, vector).select(key, "cluster")


def relevance(query: Column, doc: Column) -> Column:
    """Stand-in of a reranker: logistic of ten times the share of the query's words that the document has, less five."""
    q, d = F.array_distinct(F.split(F.lower(query), "\\W+")), F.array_distinct(F.split(F.lower(doc), "\\W+"))
    share = F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1))
    return 1 / (1 + F.exp(-(10 * share - 5)))
