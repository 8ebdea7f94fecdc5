"""Mixing sources to target weights by exact block quotas, with DataFrame functions only.

A source is dealt into blocks of about ``block_rows`` documents by a hash. Its target gives whole passes over the source and a rest.
The rest is taken in the order of blocks and of rows inside them, both permuted: a row is taken if its words still fit. So whole
blocks go first; from the block in which the rest runs out on, blocks are gone through row by row, and what a long document leaves over goes to
the rows and blocks after it. The words so taken from a block are its quota. A block drawn in a pass is a unit. A tree splits the units among
the shards: each node permutes its units and hands one half to either side, so the numbers of units by source on a side are a
multivariate hypergeometric draw with exact totals, and shards hold disjoint units. Rows are put in a random order within their shard.

Orders over sources, over the blocks of a source and over the units of a node are range-partitioned (``ordering.running_sum``): no source
and no level of the tree is one task. All random choices are MD5 orders of keys and a seed, so reruns agree on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armwave.llm.graph import stored
from armwave.operators.ordering import row_index, running_sum

WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"
STRETCH = 32  # blocks of a source that are gone through row by row at once


def _key(seed: int, label: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}{label}"), *[p.cast("string") for p in parts]).cast("binary"))


def targets(sized: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source (sk, source_size, rows, target).

    Sources in code point order, null last, weigh ``weights`` in turn; the level of the waterline is the largest
    of the levels left after filling the sources with the smallest ratio of cap to weight.
    """
    s = sized.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    s = row_index(s.withColumn("_last", F.col("sk") == ""), "_last", "sk", "rank").drop("_last")
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    s = running_sum(s, "ratio", "rank", "caps", weight=F.col("source_size") * most)
    s = stored(running_sum(s, "ratio", "rank", "used", weight=F.col("weight")), "sources")
    w, total = s.agg(F.sum("weight"), F.sum("source_size")).first()
    if w is None:
        return s.select("sk", "source_size", "rows", F.lit(0.0).alias("target"))
    level = s.agg(F.max((F.lit(total) * F.lit(share) - F.col("caps")) / (F.lit(w) - F.col("used")))).first()[0]
    return s.select("sk", "source_size", "rows", F.least(F.col("weight") * F.lit(level), (F.col("source_size") * most).cast("double")).alias("target"))


def _numbered(docs: DataFrame, text: str, key: str, source: str, seed: int, *more: Column, codec: str = "snappy") -> tuple[DataFrame, DataFrame]:
    """The rows (rid, sk, more), stored, and (rid, u) for each. ``u`` is a hash of source, key, text, and of the number of the row among those equal in these.

    Equal rows are numbered inside the partition they were read from, and after the rows of earlier partitions; only hashes are moved.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    k, sk = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    h = _key(seed, "", k, F.md5(sk.cast("binary")), F.md5(t.cast("binary")))
    rows = stored(docs.select(sk.alias("sk"), h.alias("h"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"), *more), "numbered", codec)
    each = rows.select("h", "part", "rid")
    inside = each.withColumn("turn", F.row_number().over(Window.partitionBy("h", "part").orderBy("rid")))
    many = each.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"))
    begin = F.sum("n").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    many = many.select("h", "part", F.coalesce(begin, F.lit(0)).alias("begin")).where("begin > 0")  # equal rows in several partitions
    out = inside.join(many, ["h", "part"], "left")
    return rows.drop("h", "part"), out.select("rid", _key(seed, "n", F.col("h"), F.col("turn") + F.coalesce("begin", F.lit(0))).alias("u"))


def _rests(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sk, block, words, picked) of the blocks of which the rest takes some rows but not by whole blocks; ``picked`` lists these rows.

    Per source, the next blocks that hold a row small enough are gone through, ``STRETCH`` at a time, until none is left.
    """
    state = blocks.groupBy("sk").agg((F.first("rest") - F.sum(F.when(F.col("whole"), F.col("b")).otherwise(0))).alias("left")).withColumn("after", F.lit(-1).cast("long"))
    state, done = stored(state, "left"), None
    while True:
        order = Window.partitionBy("sk").orderBy("begin")
        fitting = blocks.where(~F.col("whole")).join(state, "sk").where((F.col("least") <= F.col("left")) & (F.col("begin") > F.col("after")))
        near = fitting.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= STRETCH)
        near = stored(near.select("sk", "block", "begin", "left"), "stretch")
        if near.isEmpty():
            break
        own = rows.where("size > 0").join(near, ["sk", "block"]).where(F.col("size") <= F.col("left"))
        lists = own.groupBy("sk").agg(F.first("left").alias("left"), F.max("begin").alias("after"), F.array_sort(F.collect_list(F.struct("begin", "u", "size", "block"))).alias("each"))
        walk = F.aggregate(
            "each", F.struct(F.col("left").alias("left"), F.array().cast("array<struct<block:bigint,u:string,size:bigint>>").alias("picked")),
            lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["picked"], F.array(F.struct(x["block"], x["u"], x["size"]))).alias("picked"))).otherwise(s))
        walked = stored(lists.select("sk", "after", walk.alias("w")), "walked")
        found = walked.select("sk", F.explode("w.picked").alias("p")).select("sk", "p.block", "p.u", "p.size")
        done = found if done is None else done.unionByName(found)
        state = stored(state.join(walked.select("sk", F.col("after").alias("_after"), F.col("w.left").alias("_left")), "sk", "left")
                       .select("sk", F.coalesce("_left", "left").alias("left"), F.coalesce("_after", "after").alias("after")), "left")
    if done is None:
        return blocks.limit(0).select("sk", "block", F.lit(0).cast("long").alias("words"), F.array().cast("array<string>").alias("picked"))
    return done.groupBy("sk", "block").agg(F.sum("size").alias("words"), F.collect_list("u").alias("picked"))


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", share: float = 1.5, most: int = 2,
         shards: int = 8, block_rows: int = 256, seed: int = 9) -> DataFrame:
    """(key, row_hash, size, source_size, target, taken, shards) for every row; ``shards`` lists the shard of each copy taken.

    ``shards`` is a power of two. Null and empty texts have size 0 and are no part of the rest; a null source is a source of its own, a null key
    a value like any other. No row is taken more than ``most`` times. Rows equal in source, key and text are numbered. A source stays
    below its target by less than the words of its smallest row that the rest leaves out. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    read, names = _numbered(docs, text, key, source, seed, F.col(f"`{key}`").alias("id"), F.regexp_count(t, F.lit(WORDS)).cast("long").alias("size"))
    sized = stored(read.join(names, "rid").drop("rid"), "sizes")
    sources = targets(sized, share, most).withColumn("blocks", F.ceil(F.col("rows") / block_rows))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = stored(sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    rows = sized.join(sources, "sk").withColumn("block", F.conv(F.substring("u", 1, 8), 16, 10).cast("long") % F.col("blocks"))

    sums = rows.groupBy("sk", "block").agg(F.sum("size").alias("b"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    sums = running_sum(sums.withColumn("bh", _key(seed, "b", F.col("sk"), F.col("block"))), "bh", "block", "begin", ["sk"], F.col("b"))
    blocks = stored(sums.withColumn("whole", F.col("begin") + F.col("b") <= F.col("rest")), "blocks")
    part = stored(_rests(rows, blocks), "rests")
    quota = F.when(F.col("whole"), F.col("b")).otherwise(F.coalesce("words", F.lit(0)))
    blocks = stored(blocks.join(part, ["sk", "block"], "left").withColumn("quota", quota), "quotas")

    drawn = (F.col("passes") + F.when(F.col("quota") > 0, 1).otherwise(0)).cast("int")
    units = blocks.select("sk", "block", F.explode(F.when(drawn > 0, F.sequence(F.lit(0), drawn - 1))).alias("pass")).withColumn("node", F.lit(0))
    for level in range(max(1, shards).bit_length() - 1):
        hashed = units.withColumn("uh", _key(seed, f"u{level}", F.col("sk"), F.col("block"), F.col("pass")))
        placed = running_sum(hashed, "uh", "pass", "place", ["node"], total="of")
        right = (F.col("place") + 1) * 2 > F.col("of") + F.col("node") % 2
        units = placed.select("sk", "block", "pass", (F.col("node") * 2 + right.cast("int")).alias("node"))
    dealt = units.groupBy("sk", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "node"))), lambda u: u["node"]).alias("dealt"))
    drawn_blocks = stored(blocks.join(dealt, ["sk", "block"], "left").select("sk", "block", "quota", "whole", "picked", "dealt"), "dealt")

    rows = rows.join(drawn_blocks, ["sk", "block"])
    more = (F.col("size") > 0) & ((F.col("whole") & (F.col("quota") > 0)) | F.coalesce(F.array_contains("picked", F.col("u")), F.lit(False)))
    copies = (F.col("passes") + more.cast("int")).cast("int")
    return rows.select(F.col("id").alias(key), F.col("u").alias("row_hash"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                       F.slice(F.coalesce("dealt", F.array().cast("array<int>")), F.lit(1), copies).alias("shards"))


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", shards: int = 8, seed: int = 9, **how) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, repeats included: one partition range per shard, shuffled within it.

    Rows are told apart by the hash of source, key, text and number; rows equal in all of these are taken as often as planned, whichever they are.
    """
    drawn = plan(docs, text, key, source, shards=shards, seed=seed, **how).where(F.size("shards") > 0).select(F.col("row_hash").alias("u"), "shards")
    packed, names = _numbered(docs, text, key, source, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), codec="zstd")
    out = packed.join(names.join(drawn, "u"), "rid").select("row", F.posexplode("shards").alias("copy", "shard"), "u")
    order = _key(seed, "s", F.col("shard"), F.col("u"), F.col("copy"))
    return out.select("row", "shard", order.alias("o")).repartitionByRange("shard", "o").sortWithinPartitions("shard", "o").select("row.*")
