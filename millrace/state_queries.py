"""Queries over joins by order, records that come and go, places, counters and readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import joins, layout, records
from .queries import query
from .sources.tables import table


@query("""SELECT event_id, r.value AS price FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON e.user_id = r.user_id AND e.ts >= r.ts""")
def as_of_purchase(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "price").select("event_id", "price")


@query("""SELECT n, count(*) AS docs, sum(w)::BIGINT AS windows FROM (SELECT doc_id, w, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, n_chars FROM documents) d JOIN (SELECT range AS w, range * 700 AS a, range * 700 + 1000 AS b FROM range(40)) s ON n_chars >= a AND n_chars < b) GROUP BY n""")
def windows_of_length(spark, sf):
    w = spark.range(40).select(F.col("id").alias("w"), (F.col("id") * 700).alias("a"), (F.col("id") * 700 + 1000).alias("b"))
    met = joins.in_windows(table(spark, sf, "documents").select("doc_id", "n_chars"), w, "n_chars", "a", "b", 1000)
    each = met.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return each.groupBy("n").agg(F.sum("n").alias("docs"), F.sum("w").alias("windows"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (SELECT i FROM (SELECT unnest([5, 15, 25, 40]) AS a, unnest([0, 1, 2, 3]) AS i) ORDER BY abs(a - l_quantity), i LIMIT 1) AS col FROM lineitem""")
def nearest_columns(spark, sf):
    at = joins.nearest_anchor(F.col("l_quantity"), F.array(*map(F.lit, (5.0, 15.0, 25.0, 40.0))))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", at.alias("col"))


@query("""SELECT p_partkey, CASE WHEN l THEN 'undeclared' ELSE 'missing' END AS drift FROM (SELECT l_partkey AS p_partkey, true AS l FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT p_partkey, true FROM part WHERE p_size > 9
  UNION ALL (SELECT p_partkey, false FROM part WHERE p_size > 9 EXCEPT SELECT l_partkey, false FROM lineitem WHERE l_discount > 0.09))""")
def drift_of_parts(spark, sf):
    listed = table(spark, sf, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return joins.unmatched(listed, table(spark, sf, "part").where("p_size > 9"), "p_partkey")


@query("""SELECT l_partkey, count(*) AS digests, sum(p)::BIGINT AS peers FROM (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1""")
def conflicting_holdings(spark, sf):
    return joins.conflicts(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag", "l_suppkey")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 7 = 0 THEN 'finish_reason' WHEN coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 50 END, 1.0) > 1.0 THEN 'temperature' ELSE 'kept' END AS reason FROM events) GROUP BY 1""")
def cacheable_answers(spark, sf):
    k = F.col("event_id")
    reason = records.cacheable(F.col("event_type") == "error", F.when(k % 5 == 0, " ").otherwise("x"), F.when(k % 7 == 0, "length"), F.when(k % 3 != 0, F.col("value") / 50), 1.0)
    return table(spark, sf, "events").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_VEC = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""WITH e AS (SELECT vec_id, label, embedding, octet_length(encode('k' || repeat('x', (vec_id % 40)::INTEGER))) AS size, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id * 10 END AS expires FROM embeddings), live AS (SELECT * FROM e WHERE expires IS NULL OR expires > 900),
  n AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round({_VEC}, 6) AS score, greatest(a.size, b.size) <= 4 * least(a.size, b.size) AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_VEC}, 6) DESC, b.vec_id) AS r FROM e a JOIN live b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 'temperature' WHEN query_id % 60 = 0 THEN 'exact' WHEN entry_id IS NULL THEN 'miss' WHEN score < 0.3 THEN 'similarity' WHEN NOT near THEN 'length' ELSE 'hit' END AS outcome FROM (SELECT vec_id AS query_id FROM e WHERE vec_id % 20 = 0) q LEFT JOIN (SELECT * FROM n WHERE r = 1) USING (query_id)""")
def cache_lookup(spark, sf):
    """Expired entries go, a hot temperature and an exact text decide before any vector, the best entry alone may be a hit."""
    from .operators import vectors

    e = table(spark, sf, "embeddings").withColumn("size", (F.col("vec_id") % 40 + 1).cast("int")).withColumn("expires", F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") * 10))
    live = e.where(~records.expired(F.col("expires"), 900))
    asked = e.where("vec_id % 20 = 0")
    exact = records.lookup(asked.select("vec_id", "label", F.when(F.col("vec_id") % 60 == 0, "same").alias("text")), live.select("label", F.lit("same").alias("text"), F.col("vec_id").alias("entry_id")), "label", "text")
    best = vectors.nearest(asked, live, "label", 0.3, ratio=4.0)
    met = exact.select(F.col("vec_id").alias("query_id"), (F.col("entry_id").isNotNull()).alias("same")).join(best, "query_id", "left")
    outcome = F.when(F.col("query_id") % 100 == 0, "temperature").when(F.col("same"), "exact").when(F.col("entry_id").isNull(), "miss").when(F.col("score") < 0.3, "similarity").when(~F.col("hit"), "length").otherwise("hit")
    return met.select("query_id", outcome.alias("outcome"))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name DESC, c_custkey DESC) AS n FROM customer) WHERE n <= 20""")
def notes_kept(spark, sf):
    return records.kept_soonest(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", "c_name", "c_custkey", 20).select("c_nationkey", "c_custkey")


@query("""WITH s AS (SELECT c_nationkey, c_custkey, c_custkey % 97 AS size, c_mktsegment IN ('BUILDING', 'MACHINERY') AS pinned, sum(c_custkey % 97) OVER (PARTITION BY c_nationkey) + 500 - 2200 AS need,
  sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE c_custkey % 97 END) OVER (PARTITION BY c_nationkey) AS loose, coalesce(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE c_custkey % 97 END) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM customer)
  SELECT c_nationkey, c_custkey, 'evict' AS verdict FROM s WHERE need > 0 AND need <= loose AND NOT pinned AND prior < need UNION ALL SELECT DISTINCT c_nationkey, NULL, 'pinned full' FROM s WHERE need > loose""")
def eviction_with_pins(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_custkey") % 97).alias("size"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("pinned"))
    return records.eviction(c, "c_nationkey", "c_acctbal", "c_custkey", "size", "pinned", 2200, 500)


@query("SELECT row_number() OVER (ORDER BY p, url)::INTEGER AS rank, url, p AS page_id FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url, min(page_id) AS p FROM pages GROUP BY 1 ORDER BY p, url LIMIT 40)")
def results_once(spark, sf):
    return records.deduplicated(table(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id"), "url", "page_id", 40)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def third_page(spark, sf):
    return records.paged(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 50, 25)[0]


@query("""SELECT decision, would_deny, count(*) AS n FROM (SELECT value > 80 AS would_deny, CASE WHEN value > 80 AND user_id % 2 = 1 THEN 'deny' ELSE 'allow' END AS decision FROM events) GROUP BY 1, 2""")
def dry_run_verdicts(spark, sf):
    e = records.verdicts(table(spark, sf, "events"), F.when(F.col("value") > 80, "deny").otherwise("allow"), F.col("user_id") % 2 == 0)
    return e.groupBy("decision", "would_deny").agg(F.count("*").alias("n"))


@query("""SELECT what, count(*) AS n FROM (SELECT CASE WHEN k % 11 = 0 THEN 'disabled' WHEN k % 7 = 0 THEN 'paused' WHEN k % 13 = 0 THEN 'start cursor' WHEN 100000 - k * 5 > 90000 THEN 'stale cursor' WHEN k * 9 > 100000 THEN 'not due' WHEN k % 5 = 0 THEN 'running' WHEN k % 300000 > 9000 AND k * 11 > 100000 THEN 'backoff' WHEN k % 4 = 0 THEN 'outside window'
  WHEN k % 3 > 0 OR 100000 - k * 9 > 90 THEN CASE WHEN k % 2 = 0 THEN 'run late' ELSE 'skip' END ELSE 'run' END AS what FROM (SELECT o_orderkey AS k FROM orders)) GROUP BY 1""")
def job_decisions(spark, sf):
    k = F.col("o_orderkey")
    job = {"enabled": k % 11 != 0, "paused": k % 7 == 0, "cursor": F.when(k % 13 != 0, k * 5), "now": F.lit(100_000), "due": k * 9, "running": k % 5 == 0, "retry_at": F.when(k % 300_000 > 9000, k * 11), "in_window": k % 4 != 0, "missed": k % 3, "catch_up": k % 2 == 0}
    return table(spark, sf, "orders").groupBy(records.decision(job, 90_000, 90).alias("what")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE r AS (SELECT l_suppkey, y, h, id, row_number() OVER (PARTITION BY l_suppkey ORDER BY y, id) AS n FROM (SELECT l_suppkey, l_extendedprice / 700 AS y, l_quantity / 4 AS h, l_orderkey * 8 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey, l_orderkey * 8 + l_linenumber ORDER BY l_partkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1),
  s AS (SELECT l_suppkey, id, n, y AS base, h AS high, 0::BIGINT AS line FROM r WHERE n = 1 UNION ALL SELECT r.l_suppkey, r.id, r.n, CASE WHEN abs(r.y - base) > 0.5 * high THEN r.y ELSE base END, CASE WHEN abs(r.y - base) > 0.5 * high THEN r.h ELSE greatest(high, r.h) END, line + (abs(r.y - base) > 0.5 * high)::BIGINT FROM s JOIN r ON r.l_suppkey = s.l_suppkey AND r.n = s.n + 1)
  SELECT l_suppkey, id, line FROM s""")
def baselines(spark, sf):
    w = Window.partitionBy("l_suppkey", "id").orderBy("l_partkey", "l_extendedprice")
    l = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("k", F.row_number().over(w)).where("k = 1")
    runs = l.select("l_suppkey", (F.col("l_extendedprice") / 700).alias("y"), (F.col("l_quantity") / 4).alias("height"), "id")
    return layout.lines(runs, "l_suppkey").select("l_suppkey", "id", "line")


@query("""WITH RECURSIVE v AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS n FROM (SELECT DISTINCT c_nationkey, c_acctbal FROM customer)),
  s AS (SELECT c_nationkey, c_acctbal, n, c_acctbal AS first, 0::BIGINT AS cluster FROM v WHERE n = 1 UNION ALL SELECT v.c_nationkey, v.c_acctbal, v.n, CASE WHEN v.c_acctbal - first > 400 THEN v.c_acctbal ELSE first END, cluster + (v.c_acctbal - first > 400)::BIGINT FROM s JOIN v ON v.c_nationkey = s.c_nationkey AND v.n = s.n + 1)
  SELECT c_nationkey::BIGINT AS c_nationkey, c_acctbal, cluster FROM s""")
def anchored_clusters(spark, sf):
    return layout.anchored(table(spark, sf, "customer").select(F.col("c_nationkey").cast("long"), "c_acctbal").distinct(), "c_nationkey", "c_acctbal", 400.0)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, s, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 / 86400.0 AS s FROM events)),
  k AS (SELECT user_id, event_id, n, s AS was, t AS said, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t = said AND abs(e.s - was) <= 1.5 THEN was ELSE e.s END, CASE WHEN e.t = said AND abs(e.s - was) <= 1.5 THEN said ELSE e.t END, NOT (e.t = said AND abs(e.s - was) <= 1.5) FROM k JOIN e ON e.user_id = k.user_id AND e.n = k.n + 1)
  SELECT user_id, event_id FROM k WHERE kept""")
def stitched_events(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) / 86400.0).alias("start"), F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    return layout.stitched(e, "user_id", 1.5).select("user_id", F.col("id").alias("event_id"))


@query("""SELECT doc_id, i::INTEGER AS i, i * 800 AS "start", least(i * 800 + 1000, n_chars) AS "end", CASE WHEN i = 0 THEN 0 ELSE i * 800 + 100 END AS keep_from, CASE WHEN i = n - 1 THEN n_chars ELSE (i + 1) * 800 + 100 END AS keep_until
  FROM (SELECT doc_id, n_chars, greatest(ceil((n_chars - 200) / 800.0), 1)::BIGINT AS n, unnest(range(greatest(ceil((n_chars - 200) / 800.0), 1)::BIGINT)) AS i FROM documents)""")
def chunk_plans(spark, sf):
    plan = layout.chunk_plan(F.col("n_chars"), 1000, 200)
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(plan).alias("i", "p")).select("doc_id", "i", "p.*")
    return d.select("doc_id", "i", *[F.col(c).cast("bigint").alias(c) for c in ("start", "end", "keep_from", "keep_until")])


@query("""SELECT l_orderkey, l_partkey, l_linenumber, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS cell FROM (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 20 THEN 1 ELSE 0 END AS fresh
  FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey * 8 + l_linenumber AS a, l_partkey * 8 + l_linenumber + l_quantity * 20 AS b FROM lineitem))""")
def cells_of_orders(spark, sf):
    a = (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("double")
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", a.alias("a"), (a + F.col("l_quantity") * 20).alias("b"))
    return layout.cells(l, "l_orderkey", "a", "b", 20.0).select("l_orderkey", "l_partkey", "l_linenumber", "cell")


@query("""SELECT user_id, max(gap)::BIGINT AS gap, arg_min(t, -gap * 100000000000 + t) AS at FROM (SELECT user_id, epoch_us(ts) // 1000000 AS t, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000) - epoch_us(ts) // 1000000 AS gap FROM events) WHERE gap >= 3600 GROUP BY user_id""")
def widest_gaps(spark, sf):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return layout.widest_gap(table(spark, sf, "events").select("user_id", s.alias("a"), s.alias("b")), "user_id", "a", "b", 3600)


@query("""SELECT user_id, event_id, CASE WHEN c2 > c1 AND s2 > s1 AND c1 IS NOT NULL THEN round((c2 - c1) * 100.0 / (s2 - s1) * 4, 6) END AS cpu, greatest(m - coalesce(CASE WHEN event_id % 3 = 0 THEN m // 3 END, CASE WHEN event_id % 3 = 1 THEN m // 4 END, 0), 0) AS memory
  FROM (SELECT user_id, event_id, event_id % 70 AS c2, lag(event_id % 70) OVER w AS c1, event_id AS s2, lag(event_id) OVER w AS s1, event_id * 1000 AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def container_readings(spark, sf):
    """Percent of processors between two readings, null where a counter is missing, stood still or went back; memory without its cache."""
    w, k = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id")
    stats = F.from_json(F.concat(F.lit("{"), F.when(k % 3 == 0, F.concat(F.lit('"inactive_file":'), F.floor(k * 1000 / 3).cast("string"))).when(k % 3 == 1, F.concat(F.lit('"cache":'), F.floor(k * 1000 / 4).cast("string"))).otherwise(""), F.lit("}")), "map<string,bigint>")
    e = table(spark, sf, "events").select("user_id", "event_id", (k % 70).alias("c2"), F.lag(k % 70).over(w).alias("c1"), k.alias("s2"), F.lag(k).over(w).alias("s1"), stats.alias("stats"))
    cpu = F.when((F.col("c2") > F.col("c1")) & (F.col("s2") > F.col("s1")), F.round((F.col("c2") - F.col("c1")) * 100.0 / (F.col("s2") - F.col("s1")) * 4, 6))
    cache = F.coalesce(F.element_at("stats", "inactive_file"), F.element_at("stats", "cache"), F.lit(0))
    return e.select("user_id", "event_id", cpu.alias("cpu"), F.greatest(k * 1000 - cache, F.lit(0)).alias("memory"))


@query("""SELECT user_id, count(*) AS buckets, min(start)::TIMESTAMP AS first_seen, max(start)::TIMESTAMP AS last_seen FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS start FROM events) GROUP BY user_id ORDER BY buckets DESC, user_id LIMIT 30""")
def presence(spark, sf):
    b = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("start")).distinct()
    return b.groupBy("user_id").agg(F.count("*").alias("buckets"), F.min("start").alias("first_seen"), F.max("start").alias("last_seen")).orderBy(F.desc("buckets"), "user_id").limit(30)


@query("""SELECT count(*) AS lookups, count(*) FILTER (event_type = 'view') AS hits, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'view') / count(*) END, 6) AS rate, count(DISTINCT user_id) AS buckets, max(value) AS oldest, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events""")
def cache_statistics(spark, sf):
    e, hit = table(spark, sf, "events"), F.col("event_type") == "view"
    return e.agg(F.count("*").alias("lookups"), F.count_if(hit).alias("hits"), F.coalesce(F.round(F.try_divide(F.count_if(hit), F.count("*")), 6), F.lit(0.0)).alias("rate"), F.countDistinct("user_id").alias("buckets"), F.max("value").alias("oldest"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""SELECT p_brand, p_type, count(*) AS models, count(*) FILTER (lower(p_name) LIKE 's%') AS ready, max(CASE WHEN p_size > 10 THEN p_size END) AS most FROM part GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50""")
def models_by_backend(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("models"), F.count_if(F.startswith(F.lower("p_name"), F.lit("s"))).alias("ready"), F.max(F.when(F.col("p_size") > 10, F.col("p_size"))).alias("most"))
    return g.orderBy("p_brand", "p_type").limit(50)


@query("""SELECT d.source, d.n AS docs, d.b AS bytes, d.l AS lines, round(d.m, 3) AS upper_median, 256 * d.n + d.b + 4 * 64 * d.n AS estimate FROM (SELECT source, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS b, sum(len(string_split(text, chr(10))))::BIGINT AS l, list_sort(list(n_chars / 7))[len(list(n_chars)) // 2 + 1] AS m FROM documents GROUP BY source) d""")
def index_totals(spark, sf):
    d = table(spark, sf, "documents").select("source", F.octet_length("text").cast("bigint").alias("b"), F.size(F.split("text", "\n")).alias("l"), (F.col("n_chars") / 7).alias("v"))
    g = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("b").alias("bytes"), F.sum("l").alias("lines"), F.array_sort(F.collect_list("v")).alias("vs"))
    return g.select("source", "docs", "bytes", "lines", F.round(F.get("vs", F.floor(F.size("vs") / 2).cast("int")), 3).alias("upper_median"), (256 * F.col("docs") + F.col("bytes") + 4 * 64 * F.col("docs")).alias("estimate"))


@query("""SELECT o_custkey, ok, failed, spent, skips, last FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS failed, round(sum(o_totalprice), 2) AS spent, coalesce(array_to_string(list_slice(list(o_orderkey::VARCHAR ORDER BY o_orderkey DESC) FILTER (o_orderstatus = 'P'), 1, 3), ','), '') AS skips, max(o_orderkey) AS last FROM orders GROUP BY 1)""")
def run_totals(spark, sf):
    s = F.col("o_orderstatus")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("ok"), F.count_if(s == "O").alias("failed"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.sort_array(F.collect_list(F.when(s == "P", F.col("o_orderkey"))), False).alias("p"), F.max("o_orderkey").alias("last"))
    return g.select("o_custkey", "ok", "failed", "spent", F.array_join(F.transform(F.slice("p", 1, 3), lambda x: x.cast("string")), ",").alias("skips"), "last")


@query("""SELECT conv_id, first_user, answers, total FROM (SELECT conv_id, min(turn) FILTER (role = 'assistant' AND text <> '') AS first_user, count(*) FILTER (role = 'assistant') AS answers, coalesce(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE sum(length(text)) END, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) + sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END))::BIGINT AS total FROM conversations GROUP BY 1)""")
def answer_usage(spark, sf):
    """The first answer that is not empty, answers, and a total that is filled from its parts where it is missing."""
    a, n = F.col("role") == "assistant", F.length("text").cast("bigint")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.when(a & (F.col("text") != ""), F.col("turn"))).alias("first_user"), F.count_if(a).alias("answers"), F.sum(n).alias("t"), F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("p"), F.sum(F.when(F.col("role") != "user", n).otherwise(0)).alias("c"))
    return g.select("conv_id", "first_user", "answers", F.coalesce(F.when(F.col("conv_id") % 3 != 0, F.col("t")), F.col("p") + F.col("c")).alias("total"))


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY r DESC, s_suppkey) AS n FROM (SELECT s_nationkey, s_suppkey, max(l_shipdate) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey <> 7 GROUP BY 1, 2)) WHERE n <= 3""")
def accepted_peers(spark, sf):
    """The latest record of each endpoint but one's own, and of those the most recently heard up to a capacity."""
    s = table(spark, sf, "supplier").where("s_suppkey <> 7").select("s_nationkey", "s_suppkey")
    heard = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("r")).join(s, "s_suppkey")
    last = Window.partitionBy("s_nationkey").orderBy(F.desc("r"), "s_suppkey")
    return heard.withColumn("n", F.row_number().over(last)).where("n <= 3").select("s_nationkey", "s_suppkey")
