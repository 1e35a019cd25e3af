"""Counts over key domains: capped keys, top values, fixed domains, collections, measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import integer_median


def top_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def capped_keys(rows: DataFrame, key: str, seen: str, most: int) -> DataFrame:
    """Counts of the `most` keys seen first, and of all later ones as "other". At most that many keys are broadcast."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    first = counts.orderBy("_seen", key).limit(most).select(key, F.lit(True).alias("_first"))
    named = counts.join(F.broadcast(first), key, "left")
    return named.groupBy(F.when(F.col("_first"), F.col(key)).otherwise("other").alias("key")).agg(F.sum("n").alias("n"))


def over_domain(domain: DataFrame, name: str, key: str, rows: DataFrame, by: str) -> DataFrame:
    """(name, n) for every member of a domain, also for those without rows; rows are counted before they meet it."""
    counts = rows.groupBy(F.col(by).alias(key)).agg(F.count("*").alias("_n"))
    return domain.join(counts, key, "left").select(name, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def collections(docs: DataFrame, collection: str, source: str, size: Column, most: int) -> DataFrame:
    """Rows, bytes and the first sources of each collection, with a mark where more sources exist."""
    each = docs.groupBy(collection, source).agg(F.count("*").alias("_n"), F.sum(size).alias("_b"))
    got = each.groupBy(collection).agg(F.sum("_n").alias("n"), F.sum("_b").alias("bytes"), F.array_sort(F.collect_list(source)).alias("_s"))
    return got.select(collection, "n", "bytes", F.array_join(F.slice("_s", 1, most), ",").alias("sources"), (F.size("_s") > most).alias("more"))


def median_rates(runs: DataFrame, key: str, tokens: str, window_us: str) -> DataFrame:
    """The median of a key's rates in thousandths of a token a second; runs of one token or at most a millisecond have none."""
    valid = runs.where((F.col(tokens) >= 2) & (F.col(window_us) > 1000))
    return integer_median(valid.select(key, F.expr(f"(({tokens} - 1) * 1000000000L) div {window_us}").alias("_rate")), key, "_rate")
