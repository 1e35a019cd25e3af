"""Counters over time: deltas with resets, rollup, histograms, exposition, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(readings: DataFrame, key: str, order: str, counters: list[str]) -> DataFrame:
    """Each reading's increase since the one before. If any counter fell, all restart from 0; the first reading has none."""
    w = Window.partitionBy(key).orderBy(order)
    before = readings.withColumns({f"_{c}": F.lag(c).over(w) for c in counters})
    fell = F.greatest(*[(F.col(c) < F.col(f"_{c}")).cast("int") for c in counters], F.lit(0)) == 1
    some = before.where(F.col(f"_{counters[0]}").isNotNull()).withColumn("reset", fell)
    return some.select(key, order, "reset", *[F.when(F.col("reset"), F.col(c)).otherwise(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in counters])


def buckets(events: DataFrame, unit: str) -> DataFrame:
    """Counts, sums and the users of each hour or day."""
    return events.groupBy(F.date_trunc(unit, "ts").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.array_sort(F.collect_set("event_type")).alias("kinds"))


def rollup(hours: DataFrame, compact_before: str) -> DataFrame:
    """Hour rows before the moment join their day's row; later ones stay."""
    old = F.col("start") < F.lit(compact_before).cast("timestamp")
    start = F.when(old, F.date_trunc("day", "start")).otherwise(F.col("start"))
    return hours.groupBy(start.alias("start"), old.alias("daily")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


def histogram(rows: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by upper bound, the last without bound."""
    counts = rows.groupBy(key).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(value).alias("le_inf"))
    long = ", ".join([f"'{b:g}', le_{i}" for i, b in enumerate(bounds)] + ["'+Inf', le_inf"])
    return counts.selectExpr(key, f"stack({len(bounds) + 1}, {long}) as (le, n)")


def escaped(label: Column) -> Column:
    """A label's value with backslash, quote and line feed escaped."""
    return F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def number(value: Column) -> Column:
    """A sample's value as text, with NaN, +Inf and -Inf for what is not finite."""
    v = value.cast("double")
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def exposition(samples: DataFrame, family: str, label: str, value: str, kind: str = "counter", about: str = "") -> DataFrame:
    """(at, line): a metric family's text, HELP and TYPE once before its series in order; a repeated series is given once, the least by value."""
    once = samples.groupBy(label).agg(F.min(value).alias("_v"))
    lines = once.select(F.concat(F.lit(f'{family}{{{label}="'), escaped(F.col(label)), F.lit('"} '), number(F.col("_v"))).alias("line"))
    head = samples.sparkSession.createDataFrame([(0, f"# HELP {family} {about}".rstrip()), (1, f"# TYPE {family} {kind}")], "at int, line string")
    return head.union(lines.select(F.lit(2).alias("at"), "line"))


def integer_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The middle value; of two middle ones their average, rounded down."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"_r": F.row_number().over(by.orderBy(value)), "_n": F.count("*").over(by)})
    middle = F.col("_r").isin(0) | (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    return ranked.where(middle).groupBy(key).agg(F.floor((F.min(value) + F.max(value)) / 2).cast("long").alias("median"))


def evicted(entries: DataFrame, group: str, last_used: str, key: str, size: str, cap: float) -> DataFrame:
    """The entries to go, least recently used first, until what stays fits the cap."""
    newer = Window.partitionBy(group).orderBy(F.desc(last_used), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_kept", F.sum(size).over(newer)).where(F.col("_kept") > cap).select(group, key)
