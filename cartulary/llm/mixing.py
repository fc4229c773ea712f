"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Sources in code point order, null last, weigh 5, 2, 1, repeating, and share the
words of all documents; a source's target stops at ``most_repeats`` times its size and the excess is shared out again by
weight (water filling). A target is an exact quota of words, laid out over the source's documents in a hashed order that
starts again when all are used, and cut into blocks of equal size.

The blocks of all sources are divided among output shards by a binary tree: each node draws, source after source, how
many of its blocks go left from the hypergeometric law given what is left to draw, so that each node splits in halves
and the quotas hold exactly. Shards take consecutive, hence disjoint, blocks of the permuted order; ``place`` orders a
shard's copies at random. Draws are hashes of the seed, so reruns agree.

A document's position in its source is the sum over the hash buckets before its own, taken in stretches, plus a running
sum in the bucket; buckets grow in number with the rows, so a source with most of the rows is spread like any other. The
sources are numbered and filled in one task and each node of the tree holds one number for each: there is one row for a
source, so this suits up to about a million sources, not one for each document.

Null texts have size 0 and are never taken; null sources form a source of their own; null ids and repeated rows are rows
as all others (equal rows are interchangeable). Long texts are counted whole. Ties in the order of filling go to the
smaller rank. ``mix`` replaces columns named as a new one, ``mixed`` keeps all. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.sources.lake import stored

# Weights of the sources, repeating.
WEIGHTS = (5, 2, 1)
ROWS_A_BUCKET, BUCKETS_A_STRETCH, ROWS_A_TASK = 512, 4096, 50_000
NEW = ("size", "source_size", "target", "taken", "shards", "place")


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*keys) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def targets(sources: DataFrame, most_repeats: int) -> DataFrame:
    """Adds rank, cap, weight and target to a row for each source (``key``, ``source_size``)."""
    number = Window.orderBy(F.col("is_null"), F.col("name"))
    rank = F.row_number().over(number)
    ranked = sources.select("*", rank.alias("rank")).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", most_repeats * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("turn", F.row_number().over(fill))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))
    ranked = ranked.withColumn("level", F.coalesce(F.min(free).over(whole)["level"], F.lit(0.0)))
    return ranked.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))


def hypergeometric(total: Column, own: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among ``own``: the quantile u of the hypergeometric law.

    The log weights of neighbouring counts differ by a ratio; three passes find their maximum, their sum, and the count
    at which the running sum reaches u of it.
    """
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - own)), F.least(own, drawn)
    counts = F.sequence(low, high)

    def onward(log: Column, k: Column) -> Column:
        j = k - 1
        ratio = (own - j).cast("double") * (drawn - j) / ((j + 1).cast("double") * (total - own - drawn + j + 1))
        return F.when(k == low, F.lit(0.0)).otherwise(log + F.ln(ratio))

    def struct(**columns):
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    def mass_of(top: Column) -> Column:
        start = struct(log=F.lit(0.0), mass=F.lit(0.0))
        return F.aggregate(counts, start, lambda a, k: struct(log=onward(a["log"], k), mass=a["mass"] + F.exp(onward(a["log"], k) - top)), lambda a: a["mass"])

    def reach(top: Column, goal: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            more = a["mass"] + F.exp(onward(a["log"], k) - top)
            return struct(log=onward(a["log"], k), mass=more, below=a["below"] + F.when(more < goal, 1).otherwise(0))

        return F.aggregate(counts, struct(log=F.lit(0.0), mass=F.lit(0.0), below=low), step, lambda a: a["below"])

    start = struct(log=F.lit(0.0), top=F.lit(0.0))
    top = F.aggregate(counts, start, lambda a, k: struct(log=onward(a["log"], k), top=F.greatest(a["top"], onward(a["log"], k))), lambda a: a["top"])
    return F.least(high, let(top, lambda t: let(u * mass_of(t), lambda goal: reach(t, goal))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def split_tree(blocks: DataFrame, depth: int, seed: int) -> DataFrame:
    """(rank, shard, n_blocks) of 2**depth shards from (rank, n_blocks): each node gives half of its blocks to the left."""
    node = blocks.agg(F.sort_array(F.collect_list(F.struct("rank", "n_blocks"))).alias("own")).select(F.lit(0).alias("node"), "own")
    for level in range(depth):
        node = node.withColumn("total", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n_blocks"]))
        node = node.withColumn("half", F.floor((F.col("total") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2).cast("long"))
        start = F.struct(F.col("total").alias("total"), F.col("half").alias("drawn"), F.expr("cast(array() as array<bigint>)").alias("left"))

        def draw(a: Column, x: Column) -> Column:
            drawn = a["drawn"] - F.coalesce(F.try_element_at(a["left"], F.lit(-1)), F.lit(0))  # what the source before took
            took = hypergeometric(a["total"], x["n_blocks"], drawn, uniform(F.lit(seed), F.lit(level), F.col("node"), x["rank"]))
            return F.struct((a["total"] - x["n_blocks"]).alias("total"), drawn.alias("drawn"), F.concat(a["left"], F.array(took)).alias("left"))

        node = node.withColumn("left", F.aggregate("own", start, draw, lambda a: a["left"]))
        left = F.zip_with("own", "left", lambda x, n: F.struct(x["rank"].alias("rank"), n.alias("n_blocks")))
        right = F.zip_with("own", "left", lambda x, n: F.struct(x["rank"].alias("rank"), (x["n_blocks"] - n).alias("n_blocks")))
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("own")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own"))))
        node = node.select(child.alias("child")).select("child.node", "child.own")
    return node.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select("x.rank", "shard", "x.n_blocks")


def sums_before(groups: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """(key, bucket, before): the sum of a value over a key's buckets with smaller numbers.

    Buckets are summed in stretches first, so no task holds all buckets of a key.
    """
    groups = groups.select(key, bucket, value, F.floor(F.col(bucket) / BUCKETS_A_STRETCH).alias("stretch"))
    below = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = groups.groupBy(key, "stretch").agg(F.sum(value).alias("whole"))
    stretches = stretches.select(key, "stretch", F.coalesce(F.sum("whole").over(below("stretch").partitionBy(key)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum(value).over(below(bucket).partitionBy(key, "stretch")), F.lit(0))
    return groups.select(key, "stretch", bucket, inside.alias("inside")).join(stretches, [key, "stretch"]).select(key, bucket, (F.col("inside") + F.col("start")).alias("before"))


def _mix(docs: DataFrame, doc_id: str, text: str, source: str, depth: int, blocks_a_shard: int, most_repeats: int, seed: int) -> tuple[DataFrame, int]:
    """(rows with the columns of ``docs`` named u0, u1, ... and ``NEW``, the number of rows)."""
    user = {c: f"u{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*user.values())
    doc_id, text, source = user[doc_id], user[text], user[source]
    n_rows = rows.count()
    n_buckets = max(1, n_rows // ROWS_A_BUCKET)
    draw = lambda k: F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed + k))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = rows.select("*", words(text).alias("size"), key.alias("key"), F.pmod(draw(0), F.lit(n_buckets)).alias("bucket"), draw(1).alias("draw"))

    # read by the sources, the stretches and the buckets: stored, so that the texts are counted once for all of them
    groups = stored(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")).coalesce(1 + n_buckets // BUCKETS_A_STRETCH))
    sources = groups.groupBy("key").agg(F.sum("words").alias("source_size"))
    sources = sources.select("*", (F.col("key") == "n").alias("is_null"), F.expr("substr(key, 2)").alias("name"))
    sources = targets(sources, most_repeats).withColumn("quota", F.round("target").cast("long"))
    whole = Window.partitionBy()
    n_blocks = blocks_a_shard << depth
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.ceil(F.sum("quota").over(whole) / n_blocks)).cast("long"))
    sources = sources.withColumn("n_blocks", F.ceil(F.col("quota") / F.col("block")).cast("long"))
    shares = split_tree(sources.select("rank", "n_blocks"), depth, seed)
    ends = F.sum("n_blocks").over(Window.partitionBy("rank").orderBy("shard"))
    shares = shares.select("rank", "shard", ends.alias("end")).groupBy("rank").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    sources = sources.select("key", "rank", "source_size", "target", "quota", "block").join(shares, "rank").drop("rank")

    groups = sums_before(groups, "key", "bucket", "words").join(sources, "key")
    inside = Window.partitionBy("key", "bucket").orderBy("draw", doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(groups, ["key", "bucket"]).withColumn("at", F.col("at") + F.col("before"))
    copies = F.sequence(F.lit(0).cast("long"), F.lit(most_repeats - 1).cast("long"))
    starts = F.transform(copies, lambda j: F.col("at") + j * F.col("source_size"))
    parts = F.transform(starts, lambda a: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("quota") - a)))
    used = F.filter(starts, lambda a: (a < F.col("quota")) & (F.col("size") > 0))
    shards = F.transform(used, lambda a: F.size(F.filter("ends", lambda e: e <= F.floor(a / F.col("block")))))
    taken = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    place = F.xxhash64("draw", F.lit(seed + 2))
    return rows.select(*user.values(), "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"), place.alias("place")), n_rows


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", depth: int = 4, blocks_a_shard: int = 64, most_repeats: int = 3, seed: int = 5) -> DataFrame:
    """The rows of ``docs`` with their part of the mix.

    ``size``, ``source_size`` and ``taken`` are words (``taken`` counts repeats; the last copy of a source may be in
    part), ``target`` is the source's. ``shards`` has the output shard, 0 to 2**depth - 1, of each copy and ``place``
    orders the copies in a shard. Columns of ``docs`` that are named as one of these are replaced.
    """
    rows, _ = _mix(docs, doc_id, text, source, depth, blocks_a_shard, most_repeats, seed)
    return rows.select(*[F.col(f"u{k}").alias(c) for k, c in enumerate(docs.columns) if c not in NEW], *NEW)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", depth: int = 6, blocks_a_shard: int = 64, most_repeats: int = 3, seed: int = 5) -> DataFrame:
    """The mix itself: whole copies of the rows of ``docs``, dealt to the shards and shuffled within them.

    A copy that the mix takes in part is kept whole if at least half of it is taken. Columns and their values are those
    of ``docs``, whatever their names. A shard is written by as many tasks as its rows need, each a range of its order.
    """
    rows, n_rows = _mix(docs, doc_id, text, source, depth, blocks_a_shard, most_repeats, seed)
    tasks = max(1, n_rows // (ROWS_A_TASK << depth))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumn("shard", F.explode(F.slice("shards", F.lit(1), copies))).withColumn("order", uniform("place", "shard"))
    rows = rows.withColumn("part", (F.col("shard") * tasks + F.floor(F.col("order") * tasks)).cast("int"))
    rows = rows.repartitionById(tasks << depth, "part").sortWithinPartitions("part", "order", "place")
    return rows.select(*[F.col(f"u{k}").alias(c) for k, c in enumerate(docs.columns)])


def op5(docs: DataFrame) -> DataFrame:
    rows = mix(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "shards")
