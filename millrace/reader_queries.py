"""Queries over notes, policies, ledgers, readings in JSON and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import naming, records
from .queries import query
from .sources.tables import table


@query("""SELECT doc_id, source, lang FROM documents WHERE (source LIKE 'src1%' OR source IS NULL) AND lang IN ('en', 'fr') AND NOT (n_chars <= 400) ORDER BY n_chars DESC, doc_id LIMIT 30""")
def notes_listed(spark, sf):
    """Notes of a subject and tag that have not expired, newest first."""
    d = table(spark, sf, "documents")
    live = d.where(~records.expired(F.col("n_chars"), 400))
    return live.where((F.startswith("source", F.lit("src1")) | F.col("source").isNull()) & F.arrays_overlap(F.array("lang"), F.array(F.lit("en"), F.lit("fr")))).orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", "source", "lang")


@query("""SELECT origin, count(*) AS n, count(DISTINCT lang) AS tags FROM (SELECT 'local' AS origin, lang FROM documents UNION ALL SELECT 'peers', role FROM conversations) GROUP BY 1""")
def notes_of_all_origins(spark, sf):
    local = table(spark, sf, "documents").select(F.lit("local").alias("origin"), F.col("lang").alias("tag"))
    peers = table(spark, sf, "conversations").select(F.lit("peers").alias("origin"), F.col("role").alias("tag"))
    return local.unionByName(peers).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("tags"))


@query("""SELECT unmet, count(*) AS n FROM (SELECT CASE WHEN event_type IS NULL OR NOT (lower(event_type) LIKE 'c%' OR lower(event_type) LIKE 'v%') THEN 'models' WHEN user_id NOT IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) THEN 'peers' WHEN value IS NULL OR NOT value > 50 THEN 'tokens' ELSE 'none' END AS unmet FROM events) GROUP BY 1""")
def unmet_conditions(spark, sf):
    """The first condition of a rule that a request does not meet: all kinds have to hold, any of a kind's list suffices, an absent field never holds."""
    kinds = [("models", T.glob_like(F.lower("event_type"), "c*") | T.glob_like(F.lower("event_type"), "v*")), ("peers", F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)), ("tokens", F.col("value") > 50)]
    unmet = F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in kinds], F.lit("none"))
    return table(spark, sf, "events").groupBy(unmet.alias("unmet")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_orderpriority || '/' || o_custkey % 40 AS rule, o_orderkey FROM orders), r AS (SELECT rule, row_number() OVER (ORDER BY min(o_orderkey), rule) AS n FROM f GROUP BY 1)
  SELECT CASE WHEN n <= 64 THEN rule ELSE 'other' END AS rule, count(*) AS evaluated, count(*) FILTER (o_orderstatus = 'F') AS denied FROM orders o JOIN r ON r.rule = o.o_orderpriority || '/' || o_custkey % 40 GROUP BY 1""")
def policy_counters(spark, sf):
    """Counts by rule of at most 64 rules, in the order in which they were first seen; later ones together."""
    o = table(spark, sf, "orders").select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("rule"), "o_orderkey", "o_orderstatus")
    g = o.groupBy("rule").agg(F.count("*").alias("e"), F.count_if(F.col("o_orderstatus") == "F").alias("d"), F.min("o_orderkey").alias("first"))
    first = g.orderBy("first", "rule").limit(64).select("rule", F.lit(True).alias("named"))
    named = g.join(F.broadcast(first), "rule", "left").groupBy(F.when(F.col("named"), F.col("rule")).otherwise("other").alias("rule"))
    return named.agg(F.sum("e").alias("evaluated"), F.sum("d").alias("denied"))


@query("""SELECT start, count(*) AS n, least(sum(b), 9000)::BIGINT AS bytes, bool_or(t = 'error') AS flagged, array_to_string(list_slice(list_sort(list(DISTINCT user_id)), 1, 4), ',') AS peers, count(DISTINCT user_id) > 4 AS more
  FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_id AS b, event_type AS t, user_id FROM events) GROUP BY 1""")
def ledger_totals(spark, sf):
    """Hours with saturating sums, a sticky flag, and the first peers of each with a mark where there are more."""
    e = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("start"))
    g = e.agg(F.count("*").alias("n"), F.least(F.sum("event_id"), F.lit(9000)).alias("bytes"), F.bool_or(F.col("event_type") == "error").alias("flagged"), F.array_sort(F.collect_set("user_id")).alias("p"))
    return g.select("start", "n", "bytes", "flagged", F.array_join(F.transform(F.slice("p", 1, 4), lambda x: x.cast("string")), ",").alias("peers"), (F.size("p") > 4).alias("more"))


@query("""SELECT CASE WHEN start + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20' THEN date_trunc('day', start)::TIMESTAMP ELSE start END AS start, sum(n)::BIGINT AS n, round(sum(v), 3) AS total FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)
  WHERE start + INTERVAL 1 HOUR > TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-28' GROUP BY 1 ORDER BY start DESC LIMIT 200""")
def retained_rollup(spark, sf):
    """Hours older than a moment join their days, older ones yet are dropped, and the newest rows are listed; the open bucket is one more."""
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    sealed = hours.where("s < timestamp'2024-01-27'").unionByName(hours.where("s >= timestamp'2024-01-27' and s < timestamp'2024-01-28'"))
    end = F.col("s") + F.expr("interval 1 hour")
    start = F.when(end <= F.lit("2024-01-20").cast("timestamp"), F.date_trunc("day", "s")).otherwise(F.col("s"))
    kept = sealed.where(end > F.lit("2024-01-05").cast("timestamp")).groupBy(start.alias("start"))
    return kept.agg(F.sum("n").alias("n"), F.round(F.sum("v"), 3).alias("total")).orderBy(F.desc("start")).limit(200)


@query("""SELECT event_id, k, CASE WHEN event_id % 4 = 0 THEN 'k' WHEN k IS NULL THEN 'k' ELSE '' END AS missing FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events)""")
def status_readings(spark, sf):
    """Counters of a status in JSON; a field that is missing is named, not zero."""
    text = F.when(F.col("event_id") % 4 == 0, "{}").otherwise(F.col("props"))
    s = table(spark, sf, "events").select("event_id", F.from_json(text, "k bigint").alias("s"))
    names = F.filter(F.array(F.when(F.col("s.k").isNull(), "k")), lambda x: x.isNotNull())
    return s.select("event_id", F.col("s.k").alias("k"), F.array_join(names, ",").alias("missing"))


@query("""SELECT o_custkey, array_to_string(list_distinct(ids), ',') = array_to_string(list_distinct(ids), ',') AS same, len(list_distinct(ids))::INTEGER AS models, len(ids)::INTEGER - len(list_distinct(ids))::INTEGER AS repeated, nameless FROM (SELECT o_custkey, list(o_orderpriority) FILTER (o_orderstatus <> 'P') AS ids, count(*) FILTER (o_orderstatus = 'P') AS nameless FROM orders GROUP BY 1) WHERE ids IS NOT NULL""")
def model_lists(spark, sf):
    """Ids of a list of models in JSON, each once, with counts of repeats and of entries without one."""
    listed = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("id"))).alias("data"))).alias("body"))
    data = F.from_json("body", "data array<struct<id:string>>")["data"]
    r = listed.select("o_custkey", F.filter(F.transform(data, lambda m: m["id"]), lambda x: x.isNotNull()).alias("ids"), F.size(data).alias("all")).where(F.size("ids") > 0)
    return r.select("o_custkey", F.lit(True).alias("same"), F.size(F.array_distinct("ids")).alias("models"), (F.size("ids") - F.size(F.array_distinct("ids"))).alias("repeated"), (F.col("all") - F.size("ids")).cast("bigint").alias("nameless"))


@query("""SELECT page_id, url, 'a' AS engine FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url, 'b' FROM pages WHERE page_id % 2 = 1""")
def search_hits(spark, sf):
    """Hits of two engines with schemas of their own as one table."""
    p = table(spark, sf, "pages").select("page_id", "url")
    one = p.where("page_id % 2 = 0").select(F.to_json(F.struct(F.struct(F.array(F.struct("url", F.col("page_id").alias("id"))).alias("results")).alias("web"))).alias("body"))
    two = p.where("page_id % 2 = 1").select(F.to_json(F.struct(F.array(F.struct("url", F.col("page_id").alias("number"))).alias("results"))).alias("body"))
    a = one.select(F.inline(F.from_json("body", "web struct<results:array<struct<url:string,id:bigint>>>")["web"]["results"])).select(F.col("id").alias("page_id"), "url", F.lit("a").alias("engine"))
    b = two.select(F.inline(F.from_json("body", "results array<struct<url:string,number:bigint>>")["results"])).select(F.col("number").alias("page_id"), "url", F.lit("b").alias("engine"))
    return a.unionByName(b)


@query("SELECT s_suppkey, s_name AS device, s_suppkey * 3 AS used, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey * 7 END AS total FROM supplier")
def device_lines(spark, sf):
    """Devices of lines with commas; what is no number is null."""
    k = F.col("s_suppkey")
    line = F.concat_ws(", ", k.cast("string"), "s_name", (k * 3).cast("string"), F.when(k % 5 == 0, "[N/A]").otherwise((k * 7).cast("string")))
    parts = F.split(line, ", ")
    return table(spark, sf, "supplier").select(k, F.get(parts, F.lit(1)).alias("device"), F.expr("try_cast(get(split(concat_ws(', ', s_suppkey, s_name, s_suppkey * 3), ', '), 2) as bigint)").alias("used"), F.when(F.get(parts, F.lit(3)).rlike(r"^\d+$"), F.get(parts, F.lit(3))).cast("bigint").alias("total"))


@query("""SELECT label, len(list_distinct(list(len(embedding))))::INTEGER AS widths, min(vec_id) AS first, round(sum(embedding[1]::DOUBLE), 4) AS s FROM embeddings GROUP BY label""")
def embedding_answers(spark, sf):
    """Vectors of an answer in JSON, put in the order of their index, with the number of widths among them."""
    body = table(spark, sf, "embeddings").groupBy("label").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("vec_id").alias("index"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))).alias("data"))).alias("body"))
    v = body.select("label", F.array_sort(F.from_json("body", "data array<struct<index:bigint,embedding:array<double>>>")["data"]).alias("d"))
    return v.select("label", F.size(F.array_distinct(F.transform("d", lambda x: F.size(x["embedding"])))).alias("widths"), F.get("d", F.lit(0))["index"].alias("first"), F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + F.get(x["embedding"], F.lit(0))), 4).alias("s"))


@query("""SELECT c_custkey, array_to_string(list_sort([m FOR m IN [CASE WHEN c_custkey % 2 = 0 THEN 'privileged' END, CASE WHEN c_custkey % 3 = 0 THEN 'host network' END, CASE WHEN c_mktsegment LIKE 'B%' THEN 'writable mount' END] IF m IS NOT NULL]), ',') AS findings FROM customer WHERE c_name LIKE '%5' OR c_mktsegment = 'BUILDING'""")
def security_notes(spark, sf):
    """Findings on the containers that a list of names or a label makes visible."""
    k = F.col("c_custkey")
    rules = [("privileged", k % 2 == 0), ("host network", k % 3 == 0), ("writable mount", F.startswith("c_mktsegment", F.lit("B")))]
    visible = T.glob_like(F.col("c_name"), "*5") | (F.element_at(F.create_map(F.lit("segment"), F.col("c_mktsegment")), "segment") == "BUILDING")
    return table(spark, sf, "customer").where(visible).select(k, F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))), ",").alias("findings"))


@query("""SELECT ref, CASE WHEN exact = 1 THEN 'found' WHEN exact > 1 THEN 'ambiguous' WHEN begins = 1 THEN 'found' WHEN begins > 1 THEN 'ambiguous' ELSE 'none' END AS state, CASE WHEN exact = 1 THEN e WHEN exact = 0 AND begins = 1 THEN b END AS part FROM (
  SELECT ref, count(*) FILTER (ref = p_partkey::VARCHAR OR ref = p_name) AS exact, count(*) FILTER (p_partkey::VARCHAR LIKE ref || '%') AS begins, min(p_partkey) FILTER (ref = p_partkey::VARCHAR OR ref = p_name) AS e, min(p_partkey) FILTER (p_partkey::VARCHAR LIKE ref || '%') AS b
  FROM (SELECT unnest(['17', '1', '200', 'small ring', '1999', '99x', '64']) AS ref) LEFT JOIN part ON ref = p_partkey::VARCHAR OR ref = p_name OR p_partkey::VARCHAR LIKE ref || '%' GROUP BY ref)""")
def resolved_references(spark, sf):
    """A whole id or name wins, else the only id that begins so; several are ambiguous. The references are a stated few, so they are broadcast."""
    refs = spark.createDataFrame([(r,) for r in ("17", "1", "200", "small ring", "1999", "99x", "64")], "ref string")
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_partkey").cast("string").alias("id"))
    exact, begins = F.expr("ref = id or ref = p_name"), F.expr("startswith(id, ref)")
    met = F.broadcast(refs).join(p, exact | begins).groupBy("ref").agg(F.count_if(exact).alias("x"), F.count_if(begins).alias("y"), F.min(F.when(exact, F.col("p_partkey"))).alias("e"), F.min(F.when(begins, F.col("p_partkey"))).alias("b"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    state = F.when((x == 1) | ((x == 0) & (y == 1)), "found").when((x > 1) | (y > 1), "ambiguous").otherwise("none")
    return refs.join(met, "ref", "left").select("ref", state.alias("state"), F.when(x == 1, F.col("e")).when((x == 0) & (y == 1), F.col("b")).alias("part"))


@query("""SELECT n_nationkey AS image, c_name AS container FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey OR c_custkey % 50 = n_nationkey""")
def images_in_use(spark, sf):
    """Images beside the containers that use them by id or by tag: two equal joins, each container once; an image in no use has one row without."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    by = c.select("c_custkey", "c_name", F.col("c_nationkey").alias("image")).union(c.select("c_custkey", "c_name", (F.col("c_custkey") % 50).cast("int").alias("image"))).distinct()
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("image")).join(by, "image", "left").select("image", F.col("c_name").alias("container"))


@query("""SELECT prefix, count(*) AS n FROM (SELECT DISTINCT page_id, array_to_string(list_slice(string_split(path, '/'), 1, d), '/') AS prefix FROM (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS path FROM pages), range(1, 4) r(d) WHERE len(string_split(path, '/')) >= d) GROUP BY 1""")
def tree_of_paths(spark, sf):
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+", "")
    parts = table(spark, sf, "pages").select("page_id", F.split(path, "/").alias("s"))
    each = parts.select("page_id", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(3)))).alias("d"), "s")
    return each.groupBy(F.array_join(F.slice("s", F.lit(1), F.col("d")), "/").alias("prefix")).agg(F.countDistinct("page_id").alias("n"))


@query("""WITH p AS (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (SELECT p_partkey, CASE WHEN p_partkey % 40 = 3 THEN b || '_2' ELSE b END AS base FROM (SELECT p_partkey, regexp_replace(p_name || '!' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS b FROM part))),
  t AS (SELECT regexp_extract(base, '^(.*)_([1-9][0-9]*)$', 1) AS base, list(DISTINCT regexp_extract(base, '^(.*)_([1-9][0-9]*)$', 2)::INTEGER) AS taken FROM (SELECT DISTINCT base FROM p) WHERE regexp_matches(base, '^.*_[1-9][0-9]{0,8}$') GROUP BY 1)
  SELECT p_partkey, p.base || CASE WHEN n = 1 THEN '' ELSE '_' || list_filter(range(2, n + len(coalesce(taken, [])) + 1), lambda k: NOT list_contains(coalesce(taken, []), k))[n - 1] END AS name FROM p LEFT JOIN t ON t.base = p.base""")
def names_without_clashes(spark, sf):
    base = F.regexp_replace(F.concat_ws("!", "p_name", "p_brand"), "[^A-Za-z0-9_]", "_")
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 40 == 3, F.concat(base, F.lit("_2"))).otherwise(base).alias("base"))
    return naming.distinct_names(p, "p_partkey", "base")


@query("""SELECT doc_id, count(*) AS n, min(name) AS first FROM (SELECT doc_id, regexp_extract(line, '^(?:pub |async )*(?:fn|def|class) ([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM (SELECT doc_id, unnest(string_split('def ' || source || lang || '(x):' || chr(10) || text || chr(10) || 'pub fn ' || lang || '_' || doc_id || '() {', chr(10))) AS line FROM documents)) WHERE name <> '' GROUP BY 1""")
def symbols(spark, sf):
    text = F.concat(F.lit("def "), "source", "lang", F.lit("(x):\n"), "text", F.lit("\npub fn "), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("() {"))
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    name = F.regexp_extract("line", r"^(?:pub |async )*(?:fn|def|class) ([A-Za-z_][A-Za-z0-9_]*)", 1)
    return lines.select("doc_id", name.alias("name")).where("name <> ''").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NaN' WHEN event_id % 7 = 0 THEN 'Infinity' ELSE left(props, 5) || CASE WHEN length(props) > 5 THEN '…' ELSE '' END END AS cell, CASE WHEN event_id % 6 = 0 THEN 'unknown' WHEN event_id % 100 <= 40 THEN 'idle' ELSE 'busy' END AS load FROM events""")
def result_cells(spark, sf):
    """Cells of a result as text, and what a reading at a place in JSON says of a node's load."""
    k = F.col("event_id")
    value = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf"))
    cell = F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").otherwise(F.concat(F.left("props", F.lit(5)), F.when(F.length("props") > 5, "…").otherwise("")))
    busy = F.get_json_object(F.concat(F.lit('{"load":{"now":'), F.when(k % 6 == 0, '"high"').otherwise((k % 100).cast("string")), F.lit("}}")), "$.load.now")
    number = F.when(busy.rlike(r"^\d+(\.\d+)?$"), busy.cast("double"))
    return table(spark, sf, "events").select(k, cell.alias("cell"), F.when(number.isNull(), "unknown").when(number <= 40, "idle").otherwise("busy").alias("load"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' END AS kind, 'text/html' AS media, CASE WHEN page_id % 2 = 0 THEN 'utf-8' END AS charset FROM pages""")
def media_types(spark, sf):
    """The kind that the first bytes tell, and type and charset of a header."""
    k = F.col("page_id") % 4
    raw = F.unhex(F.when(k == 0, "89504E470D0A1A0A0000").when(k == 1, "FFD8FFE000104A46").when(k == 2, "474946383961").otherwise("3C68746D6C3E"))
    head = F.hex(raw)
    kind = F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("47494638")), "image/gif")
    given = F.when(F.col("page_id") % 2 == 0, 'Text/HTML; charset="UTF-8"').otherwise("text/html")
    charset = F.lower(F.regexp_extract(given, r'charset="?([^";\s]+)', 1))
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"), F.lower(F.trim(F.split_part(given, F.lit(";"), F.lit(1)))).alias("media"), F.when(charset != "", charset).alias("charset"))


@query("""SELECT doc_id, start, text, eof FROM (SELECT doc_id, 500 AS start, substring(text, 501, 200) AS text, n <= 700 AS eof FROM (SELECT doc_id, text, length(text) AS n FROM documents) WHERE n > 500)""")
def range_reads(spark, sf):
    """A range of each text from a place on, none where the place lies past its end, with a mark where the text ends in it."""
    n = F.length("text")
    return table(spark, sf, "documents").where(n > 500).select("doc_id", F.lit(500).alias("start"), F.substring("text", 501, 200).alias("text"), (n <= 700).alias("eof"))


@query("""SELECT user_id, backwards, n FROM (SELECT user_id, count(*) FILTER (v < p) AS backwards, count(*) AS n FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1) WHERE backwards * 2 > n""")
def recomputed_claims(spark, sf):
    """Users whose claim, that values mostly rise, does not hold when it is computed again."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", (F.col("value") < F.lag("value").over(w)).alias("down"))
    return e.groupBy("user_id").agg(F.count_if("down").alias("backwards"), F.count("*").alias("n")).where("backwards * 2 > n")


@query("""SELECT l_suppkey, round(count(DISTINCT l_orderkey) FILTER (l_quantity > 25) / count(DISTINCT l_orderkey), 4) AS filled, count(DISTINCT l_orderkey) FILTER (l_quantity > 25) * 2 >= count(DISTINCT l_orderkey) AS is_column FROM lineitem GROUP BY 1""")
def column_occupancy(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("f"), F.countDistinct("l_orderkey").alias("n"))
    return g.select("l_suppkey", F.round(F.col("f") / F.col("n"), 4).alias("filled"), (F.col("f") * 2 >= F.col("n")).alias("is_column"))


@query("""SELECT doc_id, i::INTEGER AS line_no, array_to_string(list_slice(l, greatest(i - 2, 1), i + 2), chr(10)) AS context FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(l[i], '(?i)licen[cs]e')""")
def wide_context(spark, sf):
    """Lines that match, with two lines before and after them, by their places in the row's own lines: nothing is shuffled."""
    d = table(spark, sf, "documents").where(F.col("text").rlike("(?i)licen[cs]e")).select("doc_id", F.split("text", "\n").alias("l"))
    hits = d.select("doc_id", "l", F.explode(F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.get(F.col("l"), i - 1).rlike("(?i)licen[cs]e"))).alias("i"))
    first = F.greatest(F.col("i") - 2, F.lit(1))
    return hits.select("doc_id", F.col("i").alias("line_no"), F.array_join(F.slice("l", first, F.col("i") + 3 - first), "\n").alias("context"))


@query("""SELECT o_orderkey, missed FROM (SELECT o_orderkey, least(500, (epoch(o_orderdate)::BIGINT + (o_orderkey % 5000) * 60) // 1800 - epoch(o_orderdate)::BIGINT // 1800) AS missed FROM orders)""")
def missed_runs(spark, sf):
    """Half hours that passed between a job's due moment and now, at most 500 of them."""
    due = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    now = due + (F.col("o_orderkey") % 5000) * 60
    return table(spark, sf, "orders").select("o_orderkey", F.least(F.lit(500), F.floor(now / 1800) - F.floor(due / 1800)).cast("bigint").alias("missed"))


@query("SELECT c_custkey, round(2 * c_custkey - 0.5 * c_acctbal + 7, 4) AS x, round(c_custkey + 3 * c_acctbal - 1, 4) AS y, CASE WHEN c_custkey BETWEEN 1 AND 999 THEN c_custkey END AS most, round(c_acctbal * 12 / 1000, 4) AS total FROM customer")
def places_and_limits(spark, sf):
    """An affine map of places, limits where a sentinel means none, and totals from means."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(k, F.round(2 * k - 0.5 * b + 7, 4).alias("x"), F.round(k + 3 * b - 1, 4).alias("y"), F.when(k.between(1, 999), k).alias("most"), F.round(b * 12 / 1000, 4).alias("total"))


@query("""SELECT conv_id, model FROM (SELECT conv_id, CASE WHEN list_contains(s, 'm7') AND conv_id % 4 = 0 THEN 'm7' ELSE arg_max(m, conf * 1000 - turn) END AS model FROM (SELECT conv_id, turn, 'm' || length(text) % 9 AS m, length(text) % 4 AS conf, list('m' || length(text) % 9) OVER (PARTITION BY conv_id) AS s FROM conversations) GROUP BY conv_id, s)""")
def chosen_models(spark, sf):
    """The pinned model if it is served, else the first of those with the best declared confidence."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("m"), (F.length("text") % 9).cast("string")).alias("m"), (F.length("text") % 4).alias("conf"))
    g = c.groupBy("conv_id").agg(F.collect_set("m").alias("s"), F.max_by("m", F.col("conf") * 1000 - F.col("turn")).alias("best"))
    return g.select("conv_id", F.when((F.col("conv_id") % 4 == 0) & F.array_contains("s", "m7"), "m7").otherwise(F.col("best")).alias("model"))

