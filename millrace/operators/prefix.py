"""Sums over all rows before a row, in two levels, and what rests on them: budgets in order, medians.

Rows are dealt by ranges of their order, sums run within a range, and the sums of
the ranges before are added: one row a range, so those few meet in one place and
no row does. The ranges' bounds are keys picked by hash from the rows, so the
same rows give the same ranges however they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a range, about; keys picked for each bound; ranges at most, beyond which they grow longer instead.
RANGE_ROWS, PICKED, MOST_RANGES = 500_000, 32, 256


def ranges(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> Column:
    """The number of a row's range: how many bounds are not after it, found by halving. About PICKED keys a range come to the driver, however many rows there are."""
    n = rows.count()
    parts = min(-(-n // range_rows), MOST_RANGES)
    if parts < 2:
        return F.lit(0)
    key = F.struct(*order)
    picked = rows.where(F.pmod(F.xxhash64(*order), F.lit(max(1, n // (parts * PICKED)))) == 0).select(key.alias("k")).distinct().orderBy("k").select(F.to_json("k"), "k")
    said = [r[0] for r in picked.collect()]
    if not said:
        return F.lit(0)
    # one literal; any keys serve as bounds, so it does no harm that JSON shortens some, but they have to be in order
    bounds = F.sort_array(F.from_json(F.lit(f"[{','.join(said[len(said) * i // parts] for i in range(1, parts))}]"), ArrayType(picked.schema["k"].dataType)))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))])
    # a step is taken if the last bound that it passes is there and not after the row
    return F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def sums_before(rows: DataFrame, order: list[str], values: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with, under each name, the sum of a value over all rows before in the order, whose columns together are unique; nulls of a value count 0."""
    part = free("_part", rows)
    own = {free(f"_v_{k}", rows): F.coalesce(v, F.lit(0)) for k, v in values.items()}
    dealt = rows.withColumns({part: ranges(rows, order, range_rows), **own})
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    few = dealt.groupBy(part).agg(*[F.sum(v).alias(v) for v in own])  # a row a range
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few.select(F.col(part).alias("_p"), *own).select("_p", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_o") for v in own])
    running = dealt.withColumns({f"{v}_w": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in own})
    both = running.join(F.broadcast(offsets), running[part] == offsets["_p"])
    return both.select(*rows.columns, *[(F.col(f"{v}_w") + F.col(f"{v}_o")).alias(k) for k, v in zip(values, own, strict=True)])


def free(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def budgeted_hits(files: DataFrame, path: str, text: str, pattern: str, most_hits: int, most_payload: int, most_scanned: int, most_line: int = 200, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hits, status) of a search through files in order of path under three budgets: hits, bytes of what is given, bytes read.

    A file is begun while all three are within bounds, and a line within a file while the first two are, so the last hit may go past a bound.
    hits has path, line (from 1) and the line's first characters; status has one row: files_read, hits, truncated, which says that a file or
    a line was left unseen. Counts of all files are summed first; lines are only cut out of files that are begun. Null texts are skipped.
    """
    found = F.filter(F.transform(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n"), lambda l, i: F.struct((i + 1).cast("int").alias("line"), F.substring(l, 1, most_line).alias("text"), l.rlike(pattern).alias("hit"))), lambda x: x["hit"])
    known = files.where(F.col(text).isNotNull())
    paid = F.aggregate("_hits", F.lit(0).cast("long"), lambda s, h: s + F.octet_length(h["text"]))
    lines = F.size(F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n"))
    counted = known.select(path, F.octet_length(text).cast("long").alias("_bytes"), lines.alias("_lines"), found.alias("_hits")).withColumns({"_n": F.size("_hits"), "_paid": paid})
    sizes = sums_before(counted.drop("_hits"), [path], {"_hits_before": F.col("_n"), "_paid_before": F.col("_paid"), "_read_before": F.col("_bytes")}, range_rows)
    begun = sizes.where((F.col("_hits_before") < most_hits) & (F.col("_paid_before") < most_payload) & (F.col("_read_before") < most_scanned))
    each = begun.join(counted.select(path, "_hits"), path).select(path, "_lines", "_hits_before", "_paid_before", F.posexplode("_hits").alias("_i", "h")).select(path, "_lines", "_hits_before", "_paid_before", "_i", "h.line", "h.text")
    by = Window.partitionBy(path).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_paid_before") + F.coalesce(F.sum(F.octet_length("text")).over(by), F.lit(0))
    hits = each.withColumns({"_at": F.col("_hits_before") + F.col("_i"), "_spent": spent}).where((F.col("_at") < most_hits) & (F.col("_spent") < most_payload))
    # the hit that reaches a bound leaves lines unseen unless it stands in its file's last line
    reaches = (F.col("_at") + 1 >= most_hits) | (F.col("_spent") + F.octet_length("text") >= most_payload)
    ended = hits.agg(F.count("*").alias("hits"), F.max(reaches & (F.col("line") < F.col("_lines"))).alias("_inside"))
    read = sizes.agg(F.count_if((F.col("_hits_before") < most_hits) & (F.col("_paid_before") < most_payload) & (F.col("_read_before") < most_scanned)).alias("files_read"), F.count("*").alias("_all"))
    one = read.select("files_read", "_all", F.lit(0).cast("long").alias("hits"), F.lit(False).alias("_inside")).union(ended.select(F.lit(0), F.lit(0), "hits", F.coalesce("_inside", F.lit(False))))
    status = one.agg(F.max("files_read").alias("files_read"), F.max("hits").alias("hits"), (F.max("_inside") | (F.max("_all") > F.max("files_read"))).alias("truncated"))
    return hits.select(path, "line", "text"), status


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, upper): the middle of a key's values, of two their average rounded down, and the upper of the two.

    Equal values are counted first, so what is sorted is a key's distinct values, dealt by ranges; nulls are no values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    before = sums_before(counts, [key, value], {"_b": F.col("_n")})
    sums = sums_before(totals, [key], {"_start": F.col("_all")}).withColumnRenamed(key, "_k")
    placed = before.join(sums, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_from", F.col("_b") - F.col("_start"))
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")
    holds = lambda at: (F.col("_from") <= at) & (at < F.col("_from") + F.col("_n"))
    got = placed.where(holds(low) | holds(high)).groupBy(key).agg(F.min(value).alias("_l"), F.max(value).alias("_h"))
    return got.select(key, F.floor((F.col("_l") + F.col("_h")) / 2).cast("long").alias("median"), F.col("_h").alias("upper"))


def evicted(entries: DataFrame, group: str, last_used: str, key: str, size: str, cap: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group, key) of the entries to go, least recently used first, until what stays of a group fits the cap; a group of any size is dealt to many tasks."""
    own = entries.select(group, last_used, key, F.col(size).alias("_size"))
    before = sums_before(own, [group, last_used, key], {"_b": F.col("_size")}, range_rows)
    sums = sums_before(own.groupBy(group).agg(F.sum("_size").alias("_all")), [group], {"_start": F.col("_all")}, range_rows)
    placed = before.join(sums, before[group].eqNullSafe(sums[group])).drop(sums[group])
    return placed.where(F.col("_all") - (F.col("_b") - F.col("_start")) > cap).select(group, key)
