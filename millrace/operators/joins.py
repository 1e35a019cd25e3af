"""Joins by order and range: the latest row before a moment, windows of places, nearest anchors, lookups by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the latest right row of its key not after its moment; of right rows at one moment the greatest value.

    Both sides are put in one order and the last value is carried on, so nothing is joined and a key needs one sort.
    """
    events = right.groupBy(key, at).agg(F.max(value).alias("_value"))
    columns = left.columns
    both = left.withColumn("_value", F.lit(None).cast(dict(events.dtypes)["_value"])).withColumn("_turn", F.lit(1)).unionByName(events.withColumn("_turn", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).where("_turn = 1").select(*columns, value)


def in_windows(rows: DataFrame, windows: DataFrame, place: str, start: str, end: str, step: int) -> DataFrame:
    """rows joined with the windows [start, end) that hold their place; places and windows meet by steps, so no pair of far ones is formed."""
    steps = windows.withColumn("_step", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor((F.col(end) - 1) / step))))
    return rows.withColumn("_step", F.floor(F.col(place) / step)).join(steps, "_step").where((F.col(place) >= F.col(start)) & (F.col(place) < F.col(end))).drop("_step")


def nearest_anchor(x: Column, anchors: Column) -> Column:
    """The place of the nearest of some anchors, the first of equally near ones."""
    far = F.transform(anchors, lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def unmatched(listed: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, drift): what is listed but not declared, and declared but not listed."""
    a, b = listed.select(key).distinct(), declared.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("drift", F.lit("undeclared")).union(b.join(a, key, "left_anti").withColumn("drift", F.lit("missing")))


def conflicts(holdings: DataFrame, ref: str, digest: str, peer: str) -> DataFrame:
    """(ref, digests, peers): references that peers hold with different digests; counted by groups, so no two peers are paired."""
    each = holdings.groupBy(ref, digest).agg(F.countDistinct(peer).alias("_p"))
    return each.groupBy(ref).agg(F.count("*").alias("digests"), F.sum("_p").alias("peers")).where("digests > 1")
