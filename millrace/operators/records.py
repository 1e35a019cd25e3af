"""Records that come and go: caches, notes, buckets and their plans of eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cacheable(error: Column, answer: Column, finish: Column, temperature: Column, most: float) -> Column:
    """The first reason for which an answer is not kept, or null."""
    return F.when(error, "error").when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty").when(F.coalesce(finish, F.lit("stop")) != "stop", "finish_reason").when(F.coalesce(temperature, F.lit(1.0)) > most, "temperature")


def expired(at: Column, now) -> Column:
    """A moment that has come; null never expires."""
    return F.coalesce(at <= now, F.lit(False))


def kept_soonest(rows: DataFrame, group: str, expires: str, created: str, key: str, cap: int) -> DataFrame:
    """At most cap rows a group: those that expire soonest go first, ties by creation and key."""
    last = Window.partitionBy(group).orderBy(F.desc(expires), F.desc(created), F.desc(key))
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= cap).drop("_n")


def eviction(entries: DataFrame, group: str, used: str, key: str, size: str, pinned: str, cap: int, incoming: int) -> DataFrame:
    """(group, key, verdict) of the entries to go so that `incoming` fits under the cap, least recently used first, pinned ones never.

    A group that can't make room has one row, with a null key and the reason.
    """
    by = Window.partitionBy(group)
    total = F.sum(size).over(by)
    loose = F.sum(F.when(F.col(pinned), 0).otherwise(F.col(size))).over(by)
    before = F.sum(F.when(F.col(pinned), 0).otherwise(F.col(size))).over(by.orderBy(F.col(used), F.col(key)).rowsBetween(Window.unboundedPreceding, -1))
    need = total + incoming - cap
    seen = entries.withColumns({"_need": need, "_loose": loose, "_before": F.coalesce(before, F.lit(0))})
    if incoming > cap:
        return entries.select(group).distinct().select(group, F.lit(None).cast(dict(entries.dtypes)[key]).alias(key), F.lit("too large").alias("verdict"))
    go = seen.where((F.col("_need") > 0) & (F.col("_need") <= F.col("_loose")) & ~F.col(pinned) & (F.col("_before") < F.col("_need"))).select(group, key, F.lit("evict").alias("verdict"))
    full = seen.where(F.col("_need") > F.col("_loose")).select(group).distinct().select(group, F.lit(None).cast(dict(entries.dtypes)[key]).alias(key), F.lit("pinned full").alias("verdict"))
    return go.union(full)


def lookup(queries: DataFrame, entries: DataFrame, bucket: str, text: str) -> DataFrame:
    """queries with `entry_id` of the least entry of the same bucket and text, or null."""
    least = entries.groupBy(bucket, text).agg(F.min("entry_id").alias("entry_id"))
    return queries.join(least, [bucket, text], "left")


def deduplicated(rows: DataFrame, url: str, position: str, most: int) -> DataFrame:
    """(rank, url, position): each address where it came first, ranked anew, at most so many."""
    first = rows.groupBy(url).agg(F.min(position).alias(position)).orderBy(position, url).limit(most)
    return first.select(F.row_number().over(Window.orderBy(position, url)).alias("rank"), url, position)


def paged(rows: DataFrame, order: list[Column], skip: int, most: int) -> tuple[DataFrame, bool]:
    """A page of rows in order, and whether more come after it."""
    more = rows.orderBy(*order).offset(skip).limit(most + 1)
    return rows.orderBy(*order).offset(skip).limit(most), more.count() > most


def verdicts(requests: DataFrame, decision: Column, dry_run: Column) -> DataFrame:
    """requests with what is done and what would be: a dry run lets through what it would deny."""
    would = decision == "deny"
    return requests.withColumns({"would_deny": would, "decision": F.when(would & dry_run, "allow").otherwise(decision)})


def decision(job: dict[str, Column], stale_s: int, late_s: int) -> Column:
    """What a schedule does with a job, by the first condition that holds."""
    j = job
    return (
        F.when(~j["enabled"], "disabled").when(j["paused"], "paused").when(j["cursor"].isNull(), "start cursor").when(j["now"] - j["cursor"] > stale_s, "stale cursor")
        .when(j["due"] > j["now"], "not due").when(j["running"], "running").when(j["retry_at"] > j["now"], "backoff").when(~j["in_window"], "outside window")
        .when((j["missed"] > 0) | (j["now"] - j["due"] > late_s), F.when(j["catch_up"], "run late").otherwise("skip")).otherwise("run")
    )
