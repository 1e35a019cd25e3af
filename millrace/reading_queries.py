"""Queries over readings in JSON: containers' totals, spoken segments, streamed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import readings
from .queries import query
from .sources.tables import table


@query("""SELECT event_id, k * 3 + k % 7 AS rx, k + 5 AS tx, CASE WHEN k % 3 = 0 THEN 0 ELSE k * 11 END AS read, CASE WHEN k % 3 = 0 THEN 0 ELSE k * 2 END AS written, CASE WHEN k % 4 > 1 THEN k + 1 END AS process_limit, CASE WHEN k % 4 = 3 THEN k * 1024 + 1 END AS memory_limit FROM (SELECT event_id, event_id AS k FROM events)""")
def container_totals(spark, sf):
    """Events as readings of containers, with two interfaces, four kinds of block operations and limits that are none."""
    k = F.col("event_id")
    net = lambda rx, tx: F.struct(rx.alias("rx_bytes"), tx.alias("tx_bytes"))
    op = lambda name, v: F.struct(F.lit(name).alias("op"), v.alias("value"))
    ops = F.when(k % 3 > 0, F.array(op("Read", k * 10), op("read", k), op("Write", k * 2), op("Total", k * 13)))
    limit = lambda n, v: F.when(n, v.cast("decimal(20,0)"))
    pids = F.coalesce(limit(k % 4 > 1, k + 1), limit(k % 4 == 1, F.lit("18446744073709551615")))
    memory = F.coalesce(limit(k % 4 == 3, k * 1024 + 1), limit(k % 4 == 2, F.lit("9223372036854771712")), limit(k % 4 == 1, F.lit("0")))
    stats = F.to_json(F.struct(F.create_map(F.lit("eth0"), net(k * 3, k), F.lit("eth1"), net(k % 7, F.lit(5).cast("bigint"))).alias("networks"), F.struct(ops.alias("io_service_bytes_recursive")).alias("blkio_stats"), F.struct(pids.alias("limit")).alias("pids_stats"), F.struct(memory.alias("limit")).alias("memory_stats")))
    return readings.container_totals(table(spark, sf, "events").select("event_id", stats.alias("s")), "s").drop("s")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, round(a, 6) AS start, round(greatest(a + d, a), 6) AS "end", event_type AS text
  FROM (SELECT user_id, event_id, event_type, event_id % 7000 / 4.0 AS a, CASE WHEN event_id % 6 = 4 THEN -1.0 ELSE 1.5 END AS d FROM events WHERE event_id % 6 <> 5)""")
def spoken_segments(spark, sf):
    """Events as segments of users' recordings, bounds written in four ways; some end before they start, some have a negative time and no place."""
    k = F.col("event_id")
    a, b = k % 7000 / 4.0, k % 7000 / 4.0 + 1.5
    clock = lambda s: F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.format_string("%06.3f", s - 60 * F.floor(s / 60)))
    said = lambda f: F.to_json(F.struct(F.concat(F.lit(" "), "event_type", F.lit("\n")).alias("text"), *f))
    kind = k % 6
    item = (
        F.when(kind == 0, said([a.alias("start"), b.alias("end")])).when(kind == 1, said([F.struct((a * 1000).alias("from"), (b * 1000).alias("to")).alias("offsets")]))
        .when(kind == 2, said([F.struct(F.replace(clock(a), F.lit("."), F.lit(",")).alias("from"), clock(b).alias("to")).alias("timestamps")])).when(kind == 3, said([(a * 100).alias("t0"), (b * 100).alias("t1")]))
        .when(kind == 4, said([a.cast("string").alias("start"), F.greatest(a - 1, F.lit(0.0)).alias("end")])).otherwise(said([F.lit(-1.0).alias("start"), b.alias("end")]))
    )
    got = readings.segments(table(spark, sf, "events").select("user_id", "event_id", item.alias("item")), "user_id", ["event_id"], "item")
    return got.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("""SELECT conv_id, min(turn * 1000) FILTER (role <> 'system' AND length(text) > 0) AS first_us, max(turn * 1000) AS total_us, count(*) FILTER (role <> 'system' AND length(text) > 0) AS deltas, arg_max(length(text), turn * 1000000 + length(text)) FILTER (role = 'user' AND text IS NOT NULL) AS prompt_tokens,
  CASE WHEN count(*) FILTER (role <> 'system' AND length(text) > 0) > 0 THEN 'measured' ELSE 'no tokens' END AS state FROM conversations GROUP BY conv_id""")
def streamed_answers(spark, sf):
    """Turns as the chunks of a streamed answer; system turns have no content, those of users tell a count."""
    n = F.length("text").cast("bigint")
    delta = F.struct(F.when(F.col("role") != "system", F.col("text")).alias("content")).alias("delta")
    payload = F.to_json(F.struct(F.array(F.struct(delta)).alias("choices"), F.when((F.col("role") == "user") & n.isNotNull(), F.struct(n.alias("prompt_tokens"))).alias("usage")))
    chunks = table(spark, sf, "conversations").select("conv_id", (F.col("turn") * 1000).alias("at"), payload.alias("payload"))
    return readings.stream_timing(chunks, "conv_id", "at", "payload").drop("completion_tokens")
