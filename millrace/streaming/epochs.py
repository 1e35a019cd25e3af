"""Hourly ledgers by event time: hours that a watermark seals, the open ones beside them, late events, capped sets of peers.

A node's watermark is the latest moment it has reported less a delay. An hour is
sealed once the watermark is past its end; an event for a sealed hour is late and
counted, but changes nothing. Peers of an hour are the `cap` least names and a
flag that more exist: such sets merge in any order and grouping to the same, and
no group is ever collected beyond the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = "interval 1 hour"
MOST_PEERS = 64


def capped_sets(rows: DataFrame, keys: list[str], item: str, cap: int = MOST_PEERS) -> DataFrame:
    """(*keys, items, more): the `cap` least distinct items of each group, and whether there are others; nulls are no items.

    Each task keeps the first cap + 1 of a group before they meet.
    """
    one = rows.where(F.col(item).isNotNull()).select(*keys, F.col(item).alias("_item")).distinct()
    first = one.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_item"))).where(F.col("_n") <= cap + 1)
    sets = first.groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("_s"))
    return sets.select(*keys, F.slice("_s", 1, cap).alias("items"), (F.size("_s") > cap).alias("more"))


def arrived(events: DataFrame, node: str, order: list[str], at: str, delay: Column) -> DataFrame:
    """events with their hour's `start`, whether they came `late`, and whether the hour is `sealed` by all that the node has sent.

    Events of a node in the order in which they came; those without a moment are left out.
    """
    known = events.where(F.col(at).isNotNull()).withColumn("start", F.date_trunc("hour", at))
    before = F.max(at).over(Window.partitionBy(node).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)) - delay
    final = F.max(at).over(Window.partitionBy(node)) - delay
    end = F.col("start") + F.expr(HOUR)
    return known.withColumns({"late": F.coalesce(end <= before, F.lit(False)), "sealed": end <= final})


def epochs(events: DataFrame, node: str, value: str, peer: str, cap: int = MOST_PEERS) -> DataFrame:
    """(node, start, n, total, late, sealed, peers, more) of events as arrived() gives them; late ones are counted and nothing else."""
    on_time = F.when(~F.col("late"), F.col(value))
    sums = events.groupBy(node, "start").agg(
        F.count_if(~F.col("late")).alias("n"), F.coalesce(F.sum(on_time), F.lit(0.0)).alias("total"), F.count_if("late").alias("late"), F.max("sealed").alias("sealed")
    )
    sets = capped_sets(events.where("not late"), [node, "start"], peer, cap)
    return with_sets(sums, sets, [node, "start"])


def with_sets(sums: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """sums with `peers` and `more` of their group's capped set, by keys that may be null."""
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    both = sums.alias("s").join(sets.alias("p"), on, "left")
    return both.select("s.*", F.coalesce("p.items", F.array().cast(dict(sets.dtypes)["items"])).alias("peers"), F.coalesce("p.more", F.lit(False)).alias("more"))


def merged(rows: DataFrame, node: str, start: Column, cap: int = MOST_PEERS) -> DataFrame:
    """Epochs of a node that begin in the same day, or whatever `start` says, as one; a set that was cut before stays marked."""
    keys = [node, "start"]
    moved = rows.withColumn("start", start)
    sums = moved.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("late").alias("late"), F.min("sealed").alias("sealed"), F.max("more").alias("_more"))
    sets = capped_sets(moved.select(*keys, F.explode("peers").alias("peer")), keys, "peer", cap)
    return with_sets(sums, sets, keys).withColumn("more", F.col("more") | F.col("_more")).drop("_more")


def window_rows(rows: DataFrame, since: Column) -> DataFrame:
    """Sealed epochs and open ones that end after `since`, those that reach into it whole; an open one in which nothing has happened is left out."""
    return rows.where((F.col("start") + F.expr(HOUR) > since) & (F.col("sealed") | (F.col("n") > 0)))


def sealed_stream(events: DataFrame, node: str, at: str, value: str, peer: str, delay: str) -> DataFrame:
    """(node, start, peer, n, total) of a stream, given once an hour's end is behind the watermark; Spark drops and counts later events.

    Its rows, appended to a table, are what folded() makes epochs of. State holds a row for each node, hour and peer until the hour is sealed.
    """
    hours = events.withWatermark(at, delay).groupBy(F.window(at, "1 hour").alias("w"), node, peer)
    return hours.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(node, F.col("w.start").alias("start"), peer, "n", "total")


def folded(parts: DataFrame, node: str, peer: str, cap: int = MOST_PEERS) -> DataFrame:
    """Sealed epochs (node, start, n, total, peers, more) of what sealed_stream() has appended."""
    sums = parts.groupBy(node, "start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return with_sets(sums, capped_sets(parts, [node, "start"], peer, cap), [node, "start"])
