"""Readings that come as JSON: totals of a container's counters, bounds of spoken segments, the timing of a streamed answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = (1 << 63) - 1
# Limits from which on a number means that there is none.
NO_PROCESS_LIMIT, NO_MEMORY_LIMIT = 1 << 40, 1 << 53
STATS = "networks map<string,struct<rx_bytes:bigint,tx_bytes:bigint>>, blkio_stats struct<io_service_bytes_recursive:array<struct<op:string,value:bigint>>>, pids_stats struct<limit:decimal(20,0)>, memory_stats struct<limit:decimal(20,0)>"
SEGMENT = 'text string, start string, "end" string, offsets struct<from:double,to:double>, timestamps struct<from:string,to:string>, t0 double, t1 double'.replace('"end"', "`end`").replace("from:", "`from`:").replace("to:", "`to`:")
CHUNK = "choices array<struct<delta:struct<content:string>>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint>"


def capped_sum(values: Column) -> Column:
    """The sum of an array of longs, at most the largest long; nulls count 0."""
    total = F.aggregate(values, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + F.coalesce(v, F.lit(0))).cast("decimal(38,0)"))
    return F.least(F.coalesce(total, F.lit(0)), F.lit(MOST)).cast("bigint")


def real_limit(limit: Column, none_from: int) -> Column:
    """A limit, null where it is absent, 0 or so large that it stands for none."""
    return F.when((limit > 0) & (limit < none_from), limit.cast("bigint"))


def container_totals(rows: DataFrame, stats: str) -> DataFrame:
    """rows with rx, tx over all interfaces, read, written over all devices, and the limits of processes and memory, of a reading in JSON.

    Operations are told apart whatever their case; any but read and write count the same bytes again and are left out. What is no JSON has totals of 0.
    """
    given = F.from_json(stats, STATS)
    s = F.col("_s")
    nets = F.map_values(s["networks"])
    entries = s["blkio_stats"]["io_service_bytes_recursive"]
    of = lambda op: capped_sum(F.transform(F.filter(entries, lambda e: F.lower(e["op"]) == op), lambda e: e["value"]))
    return rows.withColumn("_s", given).withColumns({"rx": capped_sum(F.transform(nets, lambda n: n["rx_bytes"])), "tx": capped_sum(F.transform(nets, lambda n: n["tx_bytes"])), "read": of("read"), "written": of("write"), "process_limit": real_limit(s["pids_stats"]["limit"], NO_PROCESS_LIMIT), "memory_limit": real_limit(s["memory_stats"]["limit"], NO_MEMORY_LIMIT)}).drop("_s")


def seconds(text: Column) -> Column:
    """Seconds of a number or of a clock with up to three parts, a comma or a point before fractions; null for what is negative, not finite or no time."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    good = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike(r"^\s*\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\s*\z"))
    total = F.aggregate(F.when(good, parts), F.lit(0.0), lambda a, p: a * 60 + F.trim(p).try_cast("double"))
    return F.when(total < float("inf"), total)


def segments(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(key, *order, n, start, end, text) of segments in JSON, numbered from 0 within a key.

    Bounds are the first that are whole of: start and end, offsets in thousandths, a pair of clocks, t0 and t1 in hundredths. A start below 0 is
    0 and no end is before its start. A segment without bounds or text is none. A key's rows are sorted by the order, ties by the JSON itself.
    """
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))

    def read(s: Column) -> Column:
        bounds = F.coalesce(pair(seconds(s["start"]), seconds(s["end"])), pair(s["offsets"]["from"] / 1000, s["offsets"]["to"] / 1000), pair(seconds(s["timestamps"]["from"]), seconds(s["timestamps"]["to"])), pair(s["t0"] / 100, s["t1"] / 100))
        return F.struct(F.regexp_replace(s["text"], r"(?U)^\s+|\s+$", "").alias("text"), bounds.alias("_b"))

    known = lambda x: (x["text"] != "") & x["_b"].isNotNull() & ~F.isnan(x["_b"]["a"]) & ~F.isnan(x["_b"]["b"])
    # an array of one holds what is read of a row, so that it is read once
    got = rows.select(key, *order, F.col(item).alias("_item"), F.inline(F.filter(F.transform(F.array(F.from_json(item, SEGMENT)), read), known)))
    start = F.greatest("_b.a", F.lit(0.0))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order, "_item")) - 1
    return got.select(key, *order, n.cast("long").alias("n"), start.alias("start"), F.greatest(F.col("_b.b"), start).alias("end"), "text")


def stream_timing(chunks: DataFrame, run: str, at: str, payload: str) -> DataFrame:
    """(run, first_us, total_us, deltas, prompt_tokens, completion_tokens, state) of answers streamed in chunks.

    A delta is a chunk with content that is not empty; the last chunk that tells a count of tokens is right. What is no JSON, as the mark of the
    end, tells nothing but the time; a null is no event. state is 'no events' where nothing but that came, 'no tokens' where no delta did, else 'measured'.
    """
    c = F.from_json(payload, CHUNK)
    told = chunks.select(run, F.col(at).alias("_at"), F.get(c["choices"], F.lit(0))["delta"]["content"].alias("_text"), c["usage"].alias("_u"), F.coalesce(F.trim(payload) != "[DONE]", F.lit(False)).alias("_event"))
    delta = F.coalesce(F.col("_text") != "", F.lit(False))
    last = lambda f: F.max_by(f"_u.{f}", F.when(F.col(f"_u.{f}").isNotNull(), F.struct("_at", f"_u.{f}"))).alias(f)
    got = told.groupBy(run).agg(F.min(F.when(delta, F.col("_at"))).alias("first_us"), F.max("_at").alias("total_us"), F.count_if(delta).alias("deltas"), last("prompt_tokens"), last("completion_tokens"), F.coalesce(F.bool_or("_event"), F.lit(False)).alias("_any"))
    return got.withColumn("state", F.when(F.col("deltas") > 0, "measured").when(F.col("_any"), "no tokens").otherwise("no events")).drop("_any")
