"""Queries over seeded ids and waits, zones, logs to compact, files that roll, grants, serving sets, groups of rows, the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import seeded, zones
from .operators import upkeep
from .queries import query
from .sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_64 = "18446744073709551616::UHUGEINT"
ZONE = "America/New_York"


def _fold(x: str, by: int) -> str:
    return f"xor({x}, {x} // {1 << by}::UHUGEINT)"


@query(f"""SELECT o_orderkey, printf('%016x', d::UBIGINT) AS mixed FROM (SELECT o_orderkey, {_fold('c', 31)} AS d FROM (SELECT o_orderkey, ({_fold('b', 27)} * {seeded.SECOND}::UHUGEINT) % {_64} AS c
  FROM (SELECT o_orderkey, ({_fold('a', 30)} * {seeded.FIRST}::UHUGEINT) % {_64} AS b FROM (SELECT o_orderkey, (o_orderkey::UHUGEINT + {seeded.STEP}::UHUGEINT) % {_64} AS a FROM orders))))""")
def mixed_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.lpad(F.lower(F.hex(seeded.mix64(F.col("o_orderkey")))), 16, "0").alias("mixed"))


@query(f"""SELECT event_id, (capped // 2 + (xor(b, (b * 131072) % {_64}) % (capped - capped // 2 + 1)::UHUGEINT)::BIGINT)::BIGINT AS wait_ms FROM (SELECT event_id, capped, {_fold('a', 7)} AS b
  FROM (SELECT event_id, capped, xor(s, (s * 8192) % {_64}) AS a FROM (SELECT event_id, least(30000 * pow(2, least(greatest(event_id % 23 - 1, 0), 16))::BIGINT, 3600000) AS capped,
  (event_id * 1000003 + 1 - (event_id * 1000003) % 2)::UHUGEINT AS s FROM events)))""")
def jittered_waits(spark, sf):
    wait = seeded.jittered_wait(F.col("event_id") % 23, F.col("event_id") * 1000003, 30_000, 3_600_000)
    return table(spark, sf, "events").select("event_id", wait.alias("wait_ms"))


_LOCAL = """SELECT event_id, CASE event_id % 50 WHEN 0 THEN TIMESTAMP '2024-03-10 02:30:00' WHEN 1 THEN TIMESTAMP '2024-11-03 01:30:00' ELSE date_trunc('minute', ts) + to_days((event_id % 366)::INTEGER) END AS l FROM events"""


@query(f"""SELECT event_id, strftime(CASE WHEN l >= '2024-03-10 02:00:00' AND l < '2024-03-10 03:00:00' THEN NULL WHEN l >= '2024-03-10 03:00:00' AND l < '2024-11-03 02:00:00' THEN l + INTERVAL 4 HOUR ELSE l + INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS moment,
  (hour(u) * 60 + minute(u))::BIGINT AS minute FROM (SELECT *, CASE WHEN l >= '2024-03-10 07:00:00' AND l < '2024-11-03 06:00:00' THEN l - INTERVAL 4 HOUR ELSE l - INTERVAL 5 HOUR END AS u FROM ({_LOCAL}))""")
def zone_moments(spark, sf):
    k, day = F.col("event_id") % 50, F.make_dt_interval(days=(F.col("event_id") % 366).cast("int"))
    at = F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz") + day
    local = F.when(k == 0, F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")).when(k == 1, F.lit("2024-11-03 01:30:00").cast("timestamp_ntz")).otherwise(at)
    e = table(spark, sf, "events").select("event_id", local.alias("l"))
    return e.select("event_id", zones.moment_of(F.col("l"), ZONE).cast("string").alias("moment"), zones.minute_in_zone(F.col("l"), ZONE).cast("bigint").alias("minute"))


@query("""SELECT c AS collection, lines + 1 AS log_lines, lines - live AS dead_lines, lines + 1 >= 512 AND (lines - live) / (lines + 1) >= 0.3 AS compacts, CASE WHEN lines + 1 >= 512 AND (lines - live) / (lines + 1) >= 0.3 THEN live ELSE lines END + 1 AS lines_after
  FROM (SELECT c, count(*) AS lines, count(*) FILTER (WHERE r = 1 AND event_type <> 'error') AS live FROM (SELECT *, user_id % 3 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY c)""")
def logs_to_compact(spark, sf):
    log = table(spark, sf, "events").withColumn("collection", F.col("user_id") % 3)
    return upkeep.compaction(log, "collection", "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, strlen(props) + event_id % 40 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  w AS (SELECT user_id, n, event_id, bytes, bytes AS size, false AS rotated, 0::BIGINT AS generation FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.bytes, CASE WHEN w.size + e.bytes > 100 THEN e.bytes ELSE w.size + e.bytes END, w.size + e.bytes > 100, w.generation + (w.size + e.bytes > 100)::BIGINT FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
  SELECT user_id, event_id, bytes, rotated, generation FROM w""")
def rolled_files(spark, sf):
    writes = table(spark, sf, "events").select("user_id", "event_id", (F.octet_length("props") + F.col("event_id") % 40).alias("bytes"))
    return upkeep.rolled(writes, "user_id", ["event_id"], 100)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, floor(value * 10)::BIGINT AS want, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
  b AS (SELECT user_id, n, event_id, t, want, 1500::BIGINT AS had, 0::BIGINT AS rest FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.t, e.want, least(1500, b.had - least(b.had, b.want) + ((e.t - b.t) + b.rest) // 60000), ((e.t - b.t) + b.rest) % 60000 FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
  SELECT event_id, want, least(had, want) AS granted, had - least(had, want) AS "left" FROM b""")
def granted_bytes(spark, sf):
    asks = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"), "event_id", F.floor(F.col("value") * 10).cast("bigint").alias("want"))
    return upkeep.byte_grants(asks, "user_id", "now", "event_id", "want", 1500, 1).select("event_id", "want", "granted", "left")


@query("""SELECT event_id, CASE WHEN down OR p IS NULL THEN '' ELSE array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(p, x))), ',') END AS added,
  CASE WHEN p IS NULL THEN '' WHEN down THEN array_to_string(list_sort(p), ',') ELSE array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(m, x))), ',') END AS removed
  FROM (SELECT event_id, down, m, lag(CASE WHEN NOT down THEN m END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM (SELECT event_id, user_id, ts, event_type = 'error' AS down, ['a' || event_id % 3, 'b' || event_id % 4] AS m FROM events))""")
def served_models(spark, sf):
    name = lambda c, n: F.concat(F.lit(c), (F.col("event_id") % n).cast("string"))
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.array(name("a", 3), name("b", 4)).alias("m"))
    t = upkeep.transitions(e, "user_id", ["ts", "event_id"], "m", F.col("event_type") == "error")
    return t.select("event_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""SELECT l_orderkey, max(y) AS first_y, min(y) AS last_y, count(*) AS rows FROM (SELECT *, sum(CASE WHEN cells < 2 OR far THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY y DESC, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, coalesce(lag(y) OVER w - y > 2.5 * greatest(lag(h) OVER w, h, 1.0), false) AS far FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (-20 * l_linenumber - l_partkey % 15)::DOUBLE AS y, (8 + l_suppkey % 4)::DOUBLE AS h, 1 + l_partkey % 4 AS cells FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY y DESC, l_linenumber, l_partkey, l_suppkey)))
  WHERE cells >= 2 GROUP BY l_orderkey, run HAVING count(*) >= 2""")
def table_rows_of_orders(spark, sf):
    y = -20.0 * F.col("l_linenumber") - F.col("l_partkey") % 15
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", y.alias("y"), (8.0 + F.col("l_suppkey") % 4).alias("h"), (1 + F.col("l_partkey") % 4).alias("cells"))
    return upkeep.row_groups(lines, "l_orderkey", "y", ["l_linenumber", "l_partkey", "l_suppkey"], "h", "cells")


@query(f"SELECT table_name, column_name, ordinal_position::BIGINT AS position FROM information_schema.columns WHERE table_name IN {TABLES}")
def catalog_columns(spark, sf):
    """Tables with their columns in order, from the schemas alone."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(table(spark, sf, t).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position long")
