"""Ordered rows: intervals, gaps, budgets, tails, changes of sets, neighbouring lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, n): overlapping or touching intervals of a key as one."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    islands = fresh.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def observed(ticks: DataFrame, key: str, order: list[str], poll_s: int, unit: str) -> DataFrame:
    """(start, seconds, n): time between ticks, at most two polls each, in the hour or day in which it began."""
    by = Window.partitionBy(key).orderBy(*order)
    gaps = ticks.select(F.lag(order[0]).over(by).alias("_from"), F.col(order[0]).alias("_to")).where(F.col("_from").isNotNull())
    seconds = F.least(F.unix_seconds(F.col("_to").cast("timestamp")) - F.unix_seconds(F.col("_from").cast("timestamp")), F.lit(2 * poll_s))
    return gaps.groupBy(F.date_trunc(unit, "_from").alias("start")).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))


def within_budget(rows: DataFrame, key: str, order: str, cost: str, most: int) -> DataFrame:
    """The first rows of a key whose costs together stay within the budget; the very first always."""
    by = Window.partitionBy(key).orderBy(order)
    spent = F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"spent": spent, "_n": F.row_number().over(by)}).where((F.col("_n") == 1) | (F.col("spent") <= most)).drop("_n")


def tail(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of a key, with `dropped`, the number of those before."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    dropped = F.greatest(F.count("*").over(Window.partitionBy(key)) - n, F.lit(0))
    return rows.withColumns({"_n": last, "dropped": dropped}).where(F.col("_n") <= n).drop("_n")


def set_changes(sightings: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """(key, at, added, removed): each moment's set against the one before; the first sighting changes nothing."""
    sets = sightings.groupBy(key, at).agg(F.array_sort(F.collect_set(item)).alias("_now"))
    both = sets.withColumn("_before", F.lag("_now").over(Window.partitionBy(key).orderBy(at)))
    less = lambda a, b: F.coalesce(F.array_join(F.array_except(a, b), ","), F.lit(""))
    return both.select(key, at, less("_now", "_before").alias("added"), less("_before", "_now").alias("removed"))


def lines_around(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line_no, before, line, after) of the lines that match, with their neighbours. Texts without a match are left out before they are cut."""
    lines = docs.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line"))
    by = Window.partitionBy(key).orderBy("_i")
    near = lines.withColumns({"before": F.lag("line").over(by), "after": F.lead("line").over(by)})
    return near.where(F.col("line").rlike(pattern)).select(key, (F.col("_i") + 1).alias("line_no"), "before", "line", "after")
