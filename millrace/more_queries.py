"""Further queries: ordered rows, summaries over key domains, schedules, passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.chunks import chunks
from .functions.cron import next_runs
from .operators import sequences, summaries
from .queries import query
from .sources.tables import table

_SPANS = "SELECT user_id, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + floor(value)::BIGINT * 600 AS e FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events)"


@query(f"""SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_SPANS}))) GROUP BY user_id, island""")
def merged_spans(spark, sf):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", start.alias("s"), (start + F.floor("value") * 600).alias("e"))
    return sequences.merged(e, "user_id", "s", "e")


@query("""SELECT date_trunc('day', before)::TIMESTAMP AS start, sum(least(epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', before))::BIGINT, 7200))::BIGINT AS seconds, count(*) AS n
  FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1""")
def observed_time(spark, sf):
    return sequences.observed(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 3600, "day")


@query("""SELECT conv_id, turn, spent::BIGINT AS spent FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS spent, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE n = 1 OR spent <= 300""")
def response_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return sequences.within_budget(c, "conv_id", "turn", "cost", 300).drop("cost")


@query("""SELECT conv_id, turn, role, dropped FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, greatest(count(*) OVER (PARTITION BY conv_id) - 2, 0) AS dropped FROM conversations) WHERE n <= 2""")
def last_turns(spark, sf):
    return sequences.tail(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2)


@query("""SELECT user_id, day, coalesce(array_to_string(list_sort(list_filter(cur, lambda x: NOT list_contains(before, x))), ','), '') AS added,
  coalesce(array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(cur, x))), ','), '') AS removed FROM (SELECT *, lag(cur) OVER (PARTITION BY user_id ORDER BY day) AS before FROM (
  SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, list(DISTINCT event_type) AS cur FROM events GROUP BY 1, 2))""")
def kinds_changed(spark, sf):
    return sequences.set_changes(table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts")), "user_id", "day", "event_type")


@query("""SELECT doc_id, i::INTEGER AS line_no, before, line, after FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE regexp_matches(line, '(?i)copyright|licen[cs]e')""")
def line_context(spark, sf):
    return sequences.lines_around(table(spark, sf, "documents"), "doc_id", "text", "(?i)copyright|licen[cs]e")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_sources(spark, sf):
    return summaries.top_values(table(spark, sf, "documents"), "source", 10)


@query("""SELECT CASE WHEN r <= 5 THEN source ELSE 'other' END AS key, sum(n)::BIGINT AS n FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY min(doc_id), source) AS r FROM documents WHERE source IS NOT NULL GROUP BY source) GROUP BY 1""")
def capped_sources(spark, sf):
    return summaries.capped_keys(table(spark, sf, "documents"), "source", "doc_id", 5)


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY n_name")
def suppliers_in_debt(spark, sf):
    return summaries.over_domain(table(spark, sf, "nation"), "n_name", "n_nationkey", table(spark, sf, "supplier").where("s_acctbal < 0"), "s_nationkey")


@query("""SELECT lang, sum(n)::BIGINT AS n, sum(b)::BIGINT AS bytes, array_to_string(list_slice(list_sort(list(source)), 1, 8), ',') AS sources, count(source) > 8 AS more
  FROM (SELECT lang, source, count(*) AS n, sum(octet_length(encode(text))) AS b FROM documents GROUP BY 1, 2) GROUP BY lang""")
def collection_stats(spark, sf):
    return summaries.collections(table(spark, sf, "documents"), "lang", "source", F.octet_length("text").cast("long"), 8)


@query("""SELECT l_suppkey, floor((min(v) + max(v)) / 2)::BIGINT AS median FROM (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (
  SELECT l_suppkey, (l_quantity::BIGINT - 1) * 1000000000 // (l_linenumber * 700) AS v FROM lineitem WHERE l_quantity >= 2 AND l_linenumber * 700 > 1000)) WHERE r = (n + 1) // 2 OR r = n // 2 + 1 GROUP BY 1""")
def median_rates(spark, sf):
    l = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("tokens"), (F.col("l_linenumber") * 700).cast("long").alias("window_us"))
    return summaries.median_rates(l, "l_suppkey", "tokens", "window_us")


_DAYS = "WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-06-01', INTERVAL 1 DAY)) AS day)"


@query(f"""{_DAYS}, s AS (SELECT day + INTERVAL 1 HOUR * h AS t FROM d, (VALUES (8), (10), (12), (14)) v(h) WHERE isodow(day) <= 5)
  SELECT event_id, (SELECT min(t) FROM s WHERE t > ts)::TIMESTAMP AS next_run FROM events""")
def schedule_working_days(spark, sf):
    return next_runs(table(spark, sf, "events").select("event_id", "ts"), "ts", "0 8-14/2 * * 1-5").drop("ts")


@query(f"""{_DAYS}, s AS (SELECT day + INTERVAL 390 MINUTE AS t FROM d WHERE day(day) IN (1, 15) OR isodow(day) = 7)
  SELECT event_id, (SELECT min(t) FROM s WHERE t > ts)::TIMESTAMP AS next_run FROM events""")
def schedule_either_day(spark, sf):
    return next_runs(table(spark, sf, "events").select("event_id", "ts"), "ts", "30 6 1,15 * 7").drop("ts")


@query()
def document_chunks(spark, sf):
    """Passages of every document with their headings and lines; the tests hold them against the packing written out."""
    cut = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_no", "c"))
    return cut.select("doc_id", "chunk_no", "c.*")


@query("""SELECT doc_id, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t]*\\n')) AS p FROM documents) WHERE trim(p, ' ') <> '' GROUP BY 1""")
def paragraphs(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("p")).where(F.trim("p") != "")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"))
