"""The queries of the library over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.cron import next_runs
from .operators import ledger, policy, vectors
from .plans.guard import guarded
from .sources import tables
from .sources.tables import table
from .streaming import throttle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


COSINE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


def _first_vector(e: DataFrame) -> list[float]:
    return e.where("vec_id = 0").first()["embedding"]


@query(f"SELECT a.vec_id, a.label, {COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 8")
def vec_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e, _first_vector(e), 8)


@query(f"SELECT a.vec_id, a.label, {COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label IN (1, 3) AND a.vec_id <> 0 ORDER BY score DESC, a.vec_id LIMIT 8")
def vec_topk_filtered(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e, _first_vector(e), 8, F.col("label").isin(1, 3) & (F.col("vec_id") != 0))


@query(f"""SELECT query_id, entry_id, score, score >= 0.35 AS hit FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS entry_id, {COSINE} AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS n
  FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) WHERE n = 1""")
def cache_nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.nearest(e.where("vec_id % 20 = 0"), e, "label", 0.35)


@query("""SELECT user_id AS doc, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
  WHERE n = 1 AND event_type <> 'error'""")
def log_replay(spark, sf):
    e = table(spark, sf, "events")
    return tables.latest(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select(F.col("user_id").alias("doc"), "event_id", "value")


@query("""SELECT CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN b.s IS NOT DISTINCT FROM a.s THEN 'unchanged' ELSE 'updated' END AS state, count(*) AS n
  FROM (SELECT o_orderkey AS k, o_totalprice AS s FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') b
  FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01') a ON a.k = b.k GROUP BY 1""")
def inventory_refresh(spark, sf):
    """Two listings of the orders: those before 1999, and later those from 1995 on, in which open ones have another price."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_totalprice").alias("stamp"))
    changed = F.when(F.col("o_orderstatus") == "P", F.col("stamp") + 1).otherwise(F.col("stamp"))
    return tables.refresh(o.where("o_orderdate < timestamp'1999-01-01'"), o.where("o_orderdate >= timestamp'1995-01-01'").withColumn("stamp", changed), "o_orderkey", "stamp")


@query("""WITH up AS (SELECT doc_id, upper(source) AS source, n_chars FROM documents WHERE lang <> 'en')
  SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM up) UNION ALL SELECT * FROM up) GROUP BY source""")
def upsert_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    incoming = d.where("lang <> 'en'").withColumn("source", F.upper("source"))
    return tables.upsert(d, incoming, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT l_orderkey, sum(size)::BIGINT AS bytes, sum(CASE WHEN before_end <> pos THEN 1 ELSE 0 END)::BIGINT AS broken FROM (
  SELECT *, lag(pos + size) OVER (PARTITION BY l_orderkey ORDER BY pos, size) AS before_end FROM (SELECT l_orderkey, l_linenumber * 10 AS pos, CASE WHEN l_partkey % 9 = 0 THEN 9 ELSE 10 END AS size FROM lineitem)) GROUP BY 1""")
def contiguous_parts(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).alias("pos"), F.when(F.col("l_partkey") % 9 == 0, 9).otherwise(10).alias("size"))
    return tables.contiguous(l, "l_orderkey", "pos", "size")


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def content_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT json_valid(props) AS ok, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def journal_parse(spark, sf):
    parsed = table(spark, sf, "events").select(F.from_json("props", "k bigint").alias("p"))
    return parsed.groupBy(F.col("p").isNotNull().alias("ok")).agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("SELECT source, count(*) AS n FROM documents WHERE source LIKE 'src1%' AND source NOT LIKE '%9' GROUP BY source")
def glob_allow_deny(spark, sf):
    d = table(spark, sf, "documents")
    verdict = policy.allowed(F.col("source"), [T.glob_like(F.col("source"), "src1*")], [T.glob_like(F.col("source"), "*9")])
    return d.where(verdict == "allowed").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE hour(ts) * 60 + minute(ts) >= 1380 OR hour(ts) * 60 + minute(ts) < 150 GROUP BY 1")
def night_window(spark, sf):
    e = table(spark, sf, "events")
    return e.where(T.in_minutes(F.hour("ts") * 60 + F.minute("ts"), 1380, 150)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT rule, decision, count(*) AS n FROM (SELECT
  CASE WHEN trim(event_type) = '' OR event_type IS NULL THEN 'policy.incomplete_request' WHEN value > 90 THEN 'large' WHEN event_type LIKE 'e%' THEN 'errors' WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'default' END AS rule,
  CASE WHEN trim(event_type) = '' OR event_type IS NULL THEN 'deny' WHEN value > 90 THEN 'deny' WHEN event_type LIKE 'e%' THEN 'allow' WHEN isodow(ts) >= 6 THEN 'limit' ELSE 'deny' END AS decision FROM events) GROUP BY 1, 2""")
def first_matching_rule(spark, sf):
    rules = [("large", "deny", F.col("value") > 90), ("errors", "allow", T.glob_like(F.col("event_type"), "e*")), ("weekend", "limit", F.weekday("ts") >= 5)]
    rule, decision = policy.first_match(rules, "deny", policy.missing({"event_type": F.col("event_type")}))
    return table(spark, sf, "events").groupBy(rule.alias("rule"), decision.alias("decision")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, reset, CASE WHEN reset THEN a ELSE a - pa END AS d_a, CASE WHEN reset THEN b ELSE b - pb END AS d_b FROM (
  SELECT *, (a < pa OR b < pb) AS reset FROM (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM (SELECT user_id, event_id, event_id % 50 AS a, event_id AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) WHERE pa IS NOT NULL""")
def counter_deltas(spark, sf):
    readings = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("a"), F.col("event_id").alias("b"))
    return ledger.deltas(readings, "user_id", "event_id", ["a", "b"])


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1")
def hour_buckets(spark, sf):
    return ledger.buckets(table(spark, sf, "events"), "hour").withColumn("kinds", F.array_join("kinds", ","))


@query("""SELECT CASE WHEN start < TIMESTAMP '2024-01-15' THEN date_trunc('day', start)::TIMESTAMP ELSE start END AS start, start < TIMESTAMP '2024-01-15' AS daily, sum(n)::BIGINT AS n, round(sum(total), 3) AS total
  FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1) GROUP BY 1, 2""")
def rollup_days(spark, sf):
    return ledger.rollup(ledger.buckets(table(spark, sf, "events"), "hour"), "2024-01-15 00:00:00")


@query("""WITH b AS (SELECT event_type, unnest([10.0, 50.0, 100.0, 1e300]) AS bound, unnest(['10', '50', '100', '+Inf']) AS le FROM (SELECT DISTINCT event_type FROM events))
  SELECT b.event_type, b.le, (SELECT count(*) FROM events e WHERE e.event_type = b.event_type AND e.value <= b.bound) AS n FROM b""")
def value_histogram(spark, sf):
    return ledger.histogram(table(spark, sf, "events"), "event_type", "value", [10, 50, 100])


@query("""SELECT 0 AS at, '# HELP orders_total Orders by status and a name that has to be escaped.' AS line UNION ALL SELECT 1, '# TYPE orders_total counter'
  UNION ALL SELECT 2, 'orders_total{status="' || replace(replace(replace('a\\' || o_orderstatus || '"' || chr(10), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"} ' || count(*)::VARCHAR FROM orders GROUP BY o_orderstatus""")
def metric_lines(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.concat(F.lit("a\\"), "o_orderstatus", F.lit('"\n')).alias("status")).agg(F.count("*").alias("n"))
    return ledger.exposition(counts, "orders_total", "status", "n", about="Orders by status and a name that has to be escaped.")


@query("""SELECT event_type, floor((min(v) + max(v)) / 2)::BIGINT AS median FROM (SELECT event_type, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 100)) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  WHERE r = (n + 1) // 2 OR r = n // 2 + 1 GROUP BY 1""")
def median_value(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 100).alias("v"))
    return ledger.integer_median(e, "event_type", "v")


@query("""SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, sum(c_custkey % 100) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC ROWS UNBOUNDED PRECEDING) AS kept FROM customer) WHERE kept > 500""")
def eviction_plan(spark, sf):
    c = table(spark, sf, "customer").withColumn("size", F.col("c_custkey") % 100)
    return ledger.evicted(c, "c_nationkey", "c_acctbal", "c_custkey", "size", 500)


_SQUEEZED = "trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'), ' ')"


@query(f"SELECT sha256(coalesce(strlen(role) || ':' || role, '-') || coalesce(strlen({_SQUEEZED}) || ':' || {_SQUEEZED}, '-')) AS key, min(conv_id) AS first_conv, count(*) AS n FROM conversations GROUP BY 1")
def cache_keys(spark, sf):
    key = T.joined_key(F.col("role"), T.squeezed(F.col("text")))
    return table(spark, sf, "conversations").groupBy(key.alias("key")).agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS shape, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id""")
def request_shapes(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.max_by("text", "turn").alias("last_text"))
    return c.select("conv_id", "turns", F.array_join("t.role", ">").alias("shape"), "last_text")


@query("""SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN (contains(lower(source), 'the') OR contains(lower(text), 'the')) AND (lang = 'en' OR contains(lower(source), 'en') OR contains(lower(text), 'en'))
   THEN (CASE WHEN lang = 'the' THEN 5 WHEN contains(lower(source), 'the') THEN 3 ELSE 2 END) + (CASE WHEN lang = 'en' THEN 5 WHEN contains(lower(source), 'en') THEN 3 ELSE 2 END) ELSE 0 END AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def note_search(spark, sf):
    score = T.note_score(["the", "en"], F.col("source"), F.col("text"), F.array("lang"))
    return table(spark, sf, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def page_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


ROBOTS = [("/", True), ("/en/", True), ("/*?page=", False), ("/*5$", False), ("/fr/*1", False), ("/fr/", True)]


@query("""WITH r(pattern, allow, rx) AS (VALUES ('/', true, '^/'), ('/en/', true, '^/en/'), ('/*?page=', false, '^/.*\\?page='), ('/*5$', false, '^/.*5$'), ('/fr/*1', false, '^/fr/.*1'), ('/fr/', true, '^/fr/'))
  SELECT page_id, CASE WHEN coalesce(arg_max(allow, length(pattern) * 2 + allow::INTEGER), true) THEN 'allow' ELSE 'disallow' END AS verdict
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1) AS p FROM pages) LEFT JOIN r ON regexp_matches(p, rx) GROUP BY page_id""")
def robots_verdicts(spark, sf):
    """The longest pattern that matches a path decides, of equally long ones that which allows; rules are a table."""
    rules = spark.createDataFrame([(p, a, T.robots_pattern(p)) for p, a in ROBOTS], "pattern string, allow boolean, rx string")
    return policy.longest_match(table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)", 1).alias("path")), "page_id", rules)


@query("""SELECT doc_id, i::INTEGER AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '(?i)licensed under|all rights')""")
def line_search(spark, sf):
    lines = table(spark, sf, "documents").where(F.col("text").rlike("(?i)licensed under|all rights")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike("(?i)licensed under|all rights")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


@query("SELECT host, page_id FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n <= 2")
def top_pages_by_host(spark, sf):
    w = Window.partitionBy("host").orderBy(F.length("html").desc(), "page_id")
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id", "html")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 2").select("host", "page_id")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def composite_keys(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("k"))
    return g.select("o_custkey", F.array_join(F.transform("k", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("""SELECT event_id, (date_trunc('hour', ts) + INTERVAL 1 MINUTE * (CASE WHEN minute(ts) < 5 THEN 5 WHEN minute(ts) < 25 THEN 25 WHEN minute(ts) < 45 THEN 45 ELSE 65 END))::TIMESTAMP AS next_run FROM events""")
def next_run(spark, sf):
    return next_runs(table(spark, sf, "events").select("event_id", "ts"), "ts", "5/20 * * * *").drop("ts")


_PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query(_PRICING)
def guarded_sql(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return guarded(spark, _PRICING, 100)[0]


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def nation_revenue(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_SEEN = "e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_SEEN}, d AS (SELECT user_id, n, event_id, t, 0::BIGINT AS suppressed FROM e WHERE n = 1 UNION ALL SELECT user_id, n, event_id, t, suppressed FROM (
  SELECT e.user_id, e.n, e.event_id, e.t, e.n - d.n - 1 AS suppressed, row_number() OVER (PARTITION BY d.user_id, d.n ORDER BY e.n) AS k FROM d JOIN e ON e.user_id = d.user_id AND e.n > d.n AND e.t >= d.t + 21600000) WHERE k = 1)
  SELECT user_id, event_id, suppressed FROM d""")
def throttle_users(spark, sf):
    return throttle.throttled(table(spark, sf, "events"), 6 * 3_600_000)


@query(f"""WITH RECURSIVE {_SEEN}, b AS (SELECT user_id, n, event_id, t, 3000::BIGINT AS had FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, e.event_id, e.t, least(3000, CASE WHEN b.had >= 1000 THEN b.had - 1000 ELSE b.had END + least(greatest(e.t - b.t, 0), 86400000) * 3000 // 86400000) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
  SELECT user_id, event_id, had >= 1000 AS admitted, CASE WHEN had >= 1000 THEN 0 ELSE greatest(1, ((1000 - had) * 86400000 + 2999) // 3000) END::BIGINT AS retry_ms FROM b""")
def rate_limit_users(spark, sf):
    return throttle.rate_limited(table(spark, sf, "events"), 3, 24 * 3_600_000)


@query(f"""WITH RECURSIVE {_SEEN}, w AS (SELECT user_id, n, event_id, t, t AS start, 0::BIGINT AS had FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.n, e.event_id, e.t, CASE WHEN e.t - w.start >= 43200000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.start >= 43200000 THEN 0 ELSE least(2, w.had + 1) END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
  SELECT user_id, event_id, had < 2 AS admitted FROM w""")
def fixed_window_users(spark, sf):
    return throttle.fixed_windows(table(spark, sf, "events"), 2, 12 * 3_600_000)
