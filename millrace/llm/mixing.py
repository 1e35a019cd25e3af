"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sources share a budget of words by weight; no target passes twice its source's
size, and what is over is shared again by weight. Each source's words, in
seeded order, are one stream cut into blocks of equally many words. Blocks are
the seats: sources get them by the highest quotients target / (2k - 1), then each
source's seats are dealt to its shards in the same way. Within a shard a seeded
order decides which blocks are taken once more than the others: that of the
documents, or for op6_mixing one of the blocks themselves. A document's taken
words are those of its blocks, counted once per copy, so at most twice its size.

The stage needs whole documents. In the order of documents all of a shard's but
one are taken a whole number of times, up to blocks that reach over a document's
end, so what rounding to whole copies adds or drops is half a document a shard
at most, on either side.

The seats are found without going through them one by one: two divisors bound
each party's seats from below and above, and only the few between are ranked.

A source's taken words are within a block of its share of seats, whatever its
size. Rows are dealt to shards by id and text, so rows without an id spread too.
A source's shards number a quarter of the square root of its rows, or for
op6_mixing the square root of all rows, so neither one shard's rows nor one
source's shards grow with all rows.

A null text has size 0. A null source is a source, ordered last; "" is another.
Repeated rows are mixed as separate rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
#: Words of a block, for every source at every size, and the seed.
BLOCK, SEED = 16, 20240101


def apportion(df: DataFrame, by: list[str], keys: list[str], weight: str, seats: str) -> DataFrame:
    """df with `quota`: in each group `by` its seats, dealt to the rows by Sainte-Lague; keys tell rows apart."""
    group = Window.partitionBy(*by)
    w, n, total = F.col(weight).cast("double"), F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(group), F.sum(F.col(weight).cast("double")).over(group)
    held = df.withColumns({"_n": n, "_total": total})
    seen = F.col(seats).cast("double")

    def by_divisor(shift: float) -> Column:
        share = w * (seen + F.col("_n") * shift) / F.col("_total")
        return F.when((F.col("_total") > 0) & (w > 0), F.greatest(F.floor(share + 0.5), F.lit(0))).otherwise(0).cast("long")

    sure = held.withColumn("_sure", by_divisor(-0.5)).withColumn("_most", by_divisor(0.5) + F.when(w > 0, 1).otherwise(0)).drop("_n", "_total")
    open_ = sure.withColumn("_left", F.col(seats) - F.sum("_sure").over(group)).where("_most > _sure").select(*by, *keys, F.col(weight).cast("double").alias("_w"), "_left", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat"))
    rank = Window.partitionBy(*by).orderBy(F.desc(F.col("_w") / (2 * F.col("_seat") - 1)), *keys)
    won = open_.withColumn("_rank", F.row_number().over(rank)).where("_rank <= _left").groupBy(*by, *keys).agg(F.count("*").alias("_won"))
    return sure.join(won, [*by, *keys], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sure", "_most", "_won")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(sid, source, source_size, target): the budget shared by weight, no target over `most` times its source's size."""
    numbered = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weighed = numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * float(most)
    fullest = Window.orderBy("level", "sid").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    leveled = weighed.withColumn("level", cap / F.col("w"))
    budget, weight = F.sum("source_size").over(everyone) * share, F.sum("w").over(everyone)
    used = leveled.withColumns({"water": (budget - F.coalesce(F.sum(cap).over(fullest), F.lit(0.0))) / (weight - F.coalesce(F.sum("w").over(fullest), F.lit(0.0)))})
    full = used.withColumn("full", F.col("level") <= F.col("water"))
    # the water stands where it does for the first source that it does not fill
    line = F.min(F.when(~F.col("full"), F.struct("level", "sid", "water"))).over(everyone)["water"]
    return full.withColumn("line", line).select("sid", "source", "source_size", F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("line") * F.col("w"))).cast("double").alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, salt, size) with size the number of words; salt is a hash of the text."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("salt"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, scattered: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs; scattered draws single blocks, not documents, within a shard."""
    sizes = written(sized(docs), "sizes")
    counted = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    root = F.sqrt(F.sum("rows").over(Window.partitionBy())) if scattered else F.sqrt("rows") / 4
    root = F.greatest(F.floor(root), F.lit(1)).cast("int")
    shards = counted.select(F.col("source").alias("_source"), root.alias("shards"))
    per_source = targets(counted.select("source", "source_size"))
    per_source = written(per_source.join(shards, per_source["source"].eqNullSafe(shards["_source"])).drop("_source"), "targets")
    per_source = per_source.withColumn("unit", F.lit(BLOCK).cast("long"))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("unit")).cast("long")
    quotas = written(apportion(per_source.withColumn("seats", seats), [], ["sid"], "target", "seats").withColumnRenamed("quota", "source_quota"), "quotas")

    hashed = lambda *c: F.xxhash64(F.lit(SEED), *c)
    same = sizes["source"].eqNullSafe(quotas["source"])
    dealt = written(sizes.join(quotas.select("sid", "source", "source_size", "target", "unit", "shards"), same).select("doc_id", "size", "salt", "sid", "source_size", "target", "unit", F.pmod(hashed("doc_id", "salt"), "shards").cast("int").alias("shard")), "dealt")
    full = dealt.where("size > 0")

    # where each shard's words lie in its source's stream, and the blocks that begin there
    cells = full.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("unit").alias("unit"))
    until = F.sum("words").over(Window.partitionBy("sid").orderBy("shard"))
    first = lambda at: F.ceil(at / F.col("unit")).cast("long")
    cells = cells.withColumn("from", until - F.col("words")).withColumn("first", first(F.col("from"))).withColumn("blocks", first(F.col("from") + F.col("words")) - F.col("first"))
    cells = cells.join(quotas.select("sid", F.col("source_quota")), "sid").withColumn("seats", F.least("source_quota", MOST_COPIES * F.sum("blocks").over(Window.partitionBy("sid"))))
    cells = written(apportion(cells, ["sid"], ["shard"], "blocks", "seats"), "cells")

    blocks = cells.where("blocks > 0").select("sid", "shard", "quota", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1)).alias("block"))
    # blocks by number are in the seeded order of documents
    turn = F.row_number().over(Window.partitionBy("sid", "shard").orderBy(*([hashed("sid", "block")] if scattered else []), "block"))
    copies = blocks.select("sid", "block", (F.floor(F.col("quota") / F.col("blocks")) + (turn <= F.col("quota") % F.col("blocks")).cast("long")).alias("copies")).where("copies > 0")

    order = Window.partitionBy("sid", "shard").orderBy(hashed("doc_id", "salt", F.lit("order")), "doc_id", "size", "salt").rowsBetween(Window.unboundedPreceding, 0)
    placed = full.withColumn("end", F.sum("size").over(order)).join(cells.select("sid", "shard", "from"), ["sid", "shard"]).withColumn("end", F.col("end") + F.col("from"))
    start = F.col("end") - F.col("size")
    spans = placed.select("doc_id", "size", "sid", "source_size", "target", "unit", "end", F.explode(F.sequence(F.floor(start / F.col("unit")), F.floor((F.col("end") - 1) / F.col("unit")))).alias("block"))
    inside = F.least("end", (F.col("block") + 1) * F.col("unit")) - F.greatest(start, F.col("block") * F.col("unit"))
    # the number of blocks follows the input, though Spark estimates it from the cells: never a broadcast
    met = spans.join(copies.hint("merge"), ["sid", "block"], "left").select("sid", "end", "doc_id", "size", "source_size", "target", (inside * F.coalesce("copies", F.lit(0))).alias("words"))
    taken = met.groupBy("sid", "end", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*out).union(dealt.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), scattered=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents in as many copies (0, 1 or 2) as the mix, drawn by documents, takes of them, to the nearest; those without an id share one number of copies."""
    copies = mix(docs).groupBy("doc_id").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies")).where("copies > 0")
    # the copies follow the input, so they are dealt by id at every size; hashed, as sorting would move whole texts
    copies = written(copies.select(F.col("doc_id").alias("_mix_id"), F.col("copies").alias("_mix_copies")), "copies").hint("shuffle_hash")
    met = docs.join(copies, docs["doc_id"].eqNullSafe(copies["_mix_id"]))
    return met.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)
