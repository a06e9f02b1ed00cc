"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, document after document, are packed into blocks of a fixed length. The output is a row of slots, cut into
shards. Every slot draws a source by its share from a seeded hash of its place, so that a shard's counts are multinomial; the counts of the
last shards are then corrected until every source has its whole number of slots: a source drawn too often gives slots back, from the last
shard on, and sources drawn too seldom get them. A source's slots, counted across shards, go through pseudorandom permutations of its
block indices, one for each round over its blocks, and join the blocks by index.

A permutation is a Feistel network over pairs of digits, of which the second has the first's size about, so that hardly any index leaves the range;
one that does goes through the network again.

Word positions come from prefix sums in two levels (buckets of about sqrt(rows) documents, then buckets), so that a
source with a third of all rows is never in one task; rows of one id, source and size are one row there, and are dealt out again after. Blocks, not
documents, are joined: keys are as fine as the blocks. Sums over sources or shards are prefix sums by ranges.

Targets: sources in code point order (null last) weigh `weights`, repeating; a target stops at max_repeat times its
source's size and the excess goes to the others by weight.

Defined results: null text has size 0 and takes nothing; repeated rows are documents of their own; an empty table gives
an empty mix; the same input gives the same mix, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, shuffle_width, spare
from graphloom.plans.tables import discard

WORD = "[^\\x20\\x09-\\x0D]+"
ROUNDS = 3
WALK = 16
"""Times that an index may leave the range: certain for 256 blocks and fewer, else it has a chance of 16 ** -16 at most to need more."""
LOOKUP = 4096
"""Buckets in which intervals are looked up."""
MOST_SENT = 50_000
"""Intervals that are broadcast at most, 32 bytes each."""
COPIES = 1024
"""Copies of a row that one task makes at most."""
LEAST_SHARD = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds sums (exact numbers, please) over all rows before, in an order that is total: by ranges of rows, whose own sums come first."""
    placed = rows.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(shuffle_width(rows.sparkSession), *order)
    placed = materialize(placed.withColumn("_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_all_{k}") for k in sums])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", *[F.coalesce(F.sum(f"_all_{k}").over(upto), F.lit(0)).alias(f"_base_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumns({f"_own_{k}": F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) for k in sums})
    # One row a range: never more than there are shuffle partitions.
    found = found.join(F.broadcast(base), "_part")
    return found.select(*rows.columns, *[(F.col(f"_base_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeat: int, block: int) -> DataFrame:
    """One row a source: source, rank, source_size, target, blocks, slots (its whole number of the output's slots), low (slots of all sources before)."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = with_sums_before(rows, by_name, {"rank": F.lit(1).cast("long")})
    exact = "decimal(30,6)"
    rows = rows.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int")).cast("decimal(20,6)"))
    rows = rows.withColumn("cap", (F.col("source_size") * max_repeat).cast(exact))
    rows = materialize(rows.withColumn("ratio", (F.col("cap") / F.col("w")).cast("double")), "mix-sources")
    total, all_w = rows.agg(F.sum("source_size"), F.sum("w")).first()
    if not total:
        return rows.select("source", "rank", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("slots"), F.lit(0).cast("long").alias("low"))
    # Each number of capped sources bounds the level from below; the greatest bound is the level.
    before = with_sums_before(rows, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "ws": F.col("w")})
    level = before.agg(F.max((F.lit(int(total)) - F.col("caps")).cast("double") / (F.lit(all_w) - F.col("ws")).cast("double"))).first()[0]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w").cast("double")))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    rows = rows.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    return with_sums_before(rows.select("source", "rank", "source_size", "target", "blocks", "slots"), [F.col("rank")], {"low": F.col("slots")})


def owners(units: DataFrame, at: Column, intervals: DataFrame, total: int) -> DataFrame:
    """units with rank, that of the interval (rank, low, high) in which `at` lies; the intervals cover 0 to total. An equi-join on a bucket of the range."""
    wide = max(1, -(-total // LOOKUP))
    few = intervals.count() <= MOST_SENT
    spread = intervals.filter("high > low").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide)))).select("_bucket", "rank", "low", "high")
    asked = units.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / wide))
    met = asked.join(F.broadcast(spread) if few else spread.hint("merge"), "_bucket")
    return met.filter((F.col("_at") >= F.col("low")) & (F.col("_at") < F.col("high"))).select(*units.columns, "rank")


def drawn_counts(targets: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(rank, shard, drawn): the multinomial counts of the shards."""
    spark = targets.sparkSession
    shards = -(-slots // shard_slots)
    rows = spark.range(shards).select(F.col("id").alias("shard")).repartition(shuffle_width(spark), "shard")
    size = F.least(F.lit(shard_slots).cast("long"), F.lit(slots) - F.col("shard") * shard_slots)
    rows = rows.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("place"))
    at = F.pmod(F.xxhash64(F.lit(seed), "shard", "place"), F.lit(slots).cast("long"))
    found = owners(rows, at, targets.select("rank", "low", (F.col("low") + F.col("slots")).alias("high")), slots)
    return found.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("drawn"))


def draw_counts(targets: DataFrame, slots: int, seed: int) -> DataFrame:
    """(rank, shard, blocks, first, count): how many slots each shard gives to each source, and the number of the first of them within the source; a source's counts add up to its slots."""
    shard_slots = max(LEAST_SHARD, int(slots**0.5))
    drawn = materialize(drawn_counts(targets, slots, shard_slots, seed), "mix-drawn")
    got = drawn.groupBy("rank").agg(F.sum("drawn").alias("got"))
    odds = materialize(targets.select("rank", "blocks", "slots").join(got, "rank", "left").withColumn("over", F.coalesce("got", F.lit(0)) - F.col("slots")), "mix-over")
    # Back, from the last shard on.
    later = Window.partitionBy("rank").orderBy(F.col("shard").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = drawn.join(odds.select("rank", "over"), "rank").withColumn("later", F.coalesce(F.sum("drawn").over(later), F.lit(0)))
    rows = rows.withColumn("back", F.greatest(F.lit(0), F.least("drawn", F.col("over") - F.col("later"))))
    rows = materialize(rows.select("rank", "shard", "drawn", "back"), "mix-back")
    short = with_sums_before(odds.filter("over < 0").select("rank", (-F.col("over")).alias("lack")), [F.col("rank")], {"low": F.col("lack")})
    lack = short.agg(F.sum("lack")).first()[0] or 0
    changed = rows.select("rank", "shard", (F.col("drawn") - F.col("back")).alias("count"))
    if lack:
        free = with_sums_before(rows.filter("back > 0").groupBy("shard").agg(F.sum("back").alias("free")), [F.col("shard")], {"from": F.col("free")})
        units = free.select("shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("free") - 1)).alias("unit"))
        given = owners(units, F.col("unit"), short.select("rank", "low", (F.col("low") + F.col("lack")).alias("high")), int(lack))
        changed = changed.unionByName(given.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("count")))
    counts = changed.groupBy("rank", "shard").agg(F.sum("count").alias("count")).filter("count > 0")
    first = F.sum("count").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    found = counts.join(odds.select("rank", "blocks"), "rank").withColumn("first", F.coalesce(first, F.lit(0))).select("rank", "shard", "blocks", "first", "count")
    found = materialize(found, "mix-counts")
    discard(drawn, odds, rows)
    return found


def with_permuted(rows: DataFrame, name: str, i: Column, n: Column, *key: Column) -> DataFrame:
    """Adds the place of i under a pseudorandom permutation of 0..n-1 that the key selects."""
    a, b, left, right, walk = spare(rows.columns, "wide_a", "wide_b", "left", "right", "walk")
    rows = rows.withColumn(a, F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(n)))).withColumn(b, F.ceil(n / F.col(a)))
    wide_a, wide_b = F.col(a), F.col(b)
    halves = lambda x: (F.floor(x / wide_b), F.pmod(x, wide_b))
    to_left = lambda x, y, k: F.pmod(x + F.pmod(F.xxhash64(*key, F.lit(2 * k), y), wide_a), wide_a)
    to_right = lambda x, y, k: F.pmod(y + F.pmod(F.xxhash64(*key, F.lit(2 * k + 1), x), wide_b), wide_b)
    # Once through, in steps of their own, which are compiled; what has left the range goes on in an expression, which is not.
    first = halves(i.cast("long"))
    rows = rows.withColumns({left: first[0], right: first[1]})
    for k in range(ROUNDS):
        rows = rows.withColumn(left, to_left(F.col(left), F.col(right), k))
        rows = rows.withColumn(right, to_right(F.col(left), F.col(right), k))
    rows = rows.withColumn(walk, (F.col(left) * wide_b + F.col(right)).cast("long"))

    def network(x: Column) -> Column:
        x, y = halves(x)
        for k in range(ROUNDS):
            x = to_left(x, y, k)
            y = to_right(x, y, k)
        return (x * wide_b + y).cast("long")

    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(walk), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return rows.withColumn(name, F.when(F.col(walk) < n, F.col(walk)).otherwise(again)).drop(a, b, left, right, walk)


def block_uses(counts: DataFrame, max_repeat: int, seed: int) -> DataFrame:
    """(rank, block, uses) for the blocks that some slot takes."""
    # A few bytes a shard become many slots: neither may the rows be gathered in few tasks for their size, nor the slots be broadcast for it.
    slots = counts.repartition(shuffle_width(counts.sparkSession), "rank", "shard")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    slots = slots.filter(F.col("slot") < F.col("blocks") * max_repeat)
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    slots = with_permuted(slots, "block", F.col("slot") - F.col("turn") * F.col("blocks"), F.col("blocks"), F.col("rank"), F.col("turn"), F.lit(seed))
    return slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))


def positions(sized: DataFrame) -> DataFrame:
    """(id, source, size, start): where each document's words begin in its source's row of words; documents without words are left out."""
    rows = sized.filter("size > 0").groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "mix-rows")
    n = rows.count()
    buckets = max(1, round(n**0.5))
    words = F.col("size") * F.col("copies")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("own"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("own").over(before), F.lit(0))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "base")
    within = Window.partitionBy("source", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(words).over(within), F.lit(0)))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    rows = rows.select("id", "source", "size", "copies", (F.col("base") + F.col("within")).alias("start"))
    part = lambda df, most: df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, most)))
    moved = F.col("start") + F.col("_k") * F.col("size")
    few = part(rows.filter(F.col("copies") <= COPIES), F.lit(1).cast("long")).select("id", "source", "size", moved.alias("start"))
    # Many copies: in runs of COPIES, dealt out before each is made.
    runs = part(rows.filter(F.col("copies") > COPIES), F.lit(COPIES).cast("long"))
    runs = runs.select("id", "source", "size", moved.alias("start"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("_k")).alias("copies")).repartition(shuffle_width(sized.sparkSession), "source", "start")
    return few.unionByName(part(runs, F.lit(1).cast("long")).select("id", "source", "size", moved.alias("start")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, block: int = 32, seed: int = 1) -> DataFrame:
    """One row a document: id_col, source, size, source_size, target, taken (words the mix takes of it, repeats counted)."""
    sized = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sized, weights, max_repeat, block), "mix-targets")
    slots = targets.agg(F.sum("slots")).first()[0] or 0
    about = targets.select(F.col("source").alias("_s"), "rank", "source_size", "target")
    columns = [F.col("id").alias(id_col), F.col("source").alias("source"), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken")]
    empty = (sized if not slots else sized.filter("size = 0")).join(about, F.col("source").eqNullSafe(F.col("_s"))).withColumn("taken", F.lit(0).cast("long"))
    if not slots:
        return empty.select(*columns)
    uses = block_uses(draw_counts(targets, slots, seed), max_repeat, seed)
    placed = positions(sized).join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    parts = parts.withColumn("words", inside).join(uses.hint("merge"), ["rank", "block"], "left")
    # Ranges of words are disjoint: rank and start name one document that has words.
    taken = parts.groupBy("rank", "start").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    return taken.select(*columns).unionByName(empty.select(*columns))
