"""Queries over formats, predicates and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import formats as N
from .functions import markup
from .functions import predicates as P
from .functions import writing as W
from .operators.readable import readable
from .queries import query
from .sources.tables import table


@query("""SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS plain, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS fine,
  strftime(make_timestamp((ms // 1000 + z * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN z < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(z) // 60, abs(z) % 60) AS local
  FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms, (event_id % 53 - 26) * 30 AS z FROM events)""")
def moments(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), ((F.col("event_id") % 53 - 26) * 30).alias("z"))
    return e.select("event_id", N.iso(F.col("ms")).alias("plain"), N.iso(F.col("ms"), True).alias("fine"), N.iso_offset(F.floor(F.col("ms") / 1000), F.col("z")).alias("local"))


_BOUNDS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN '2024-02-30' WHEN 5 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS t, ts FROM events"""


@query(f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_id WHEN 1 THEN epoch(date_trunc('day', ts))::BIGINT WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 3 THEN epoch(date_trunc('second', ts))::BIGINT END AS bound FROM ({_BOUNDS})""")
def time_bounds(spark, sf):
    at, d = F.col("ts").cast("timestamp"), F.col("event_id") % 7
    f = lambda p: F.date_format(at, p)
    text = F.when(d == 0, F.col("event_id").cast("string")).when(d == 1, f("yyyy-MM-dd")).when(d == 2, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(d == 3, f("yyyy-MM-dd HH:mm:ss")).when(d == 4, "2024-02-30").when(d == 5, "yesterday").otherwise(f("yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf, "events").select("event_id", N.time_bound(text).alias("bound"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, ms / 1000.0 AS seconds, CASE WHEN h < 24 THEN h * 60 + 7 END AS minute, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(event_id, 3600) END AS wait
  FROM (SELECT event_id, round(value * 1000)::BIGINT * 37 AS ms, event_id % 30 AS h FROM events)""")
def clocks(spark, sf):
    ms = F.round(F.col("value") * 1000).cast("bigint") * 37
    e = table(spark, sf, "events").select("event_id", N.clock(ms / 1000.0).alias("clock"), (F.col("event_id") % 30).alias("h"))
    wait = F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    return e.select("event_id", "clock", N.seconds_of(F.replace("clock", F.lit("."), F.lit(","))).alias("seconds"), N.minute_of_day(F.concat(F.col("h").cast("string"), F.lit(":07"))).cast("bigint").alias("minute"), N.retry_after(wait, 3600).cast("bigint").alias("wait"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' ELSE printf('%.1f %s', b / pow(1024.0, p), ['B', 'KiB', 'MiB', 'GiB', 'TiB'][p + 1]) END AS size, CASE WHEN k = 0 THEN 100.0 ELSE 100.0 * (k // 2) / k END AS done,
  CASE WHEN k = 0 THEN 0 ELSE least(2 * pow(2, least(k, 40) - 1), 60) END::BIGINT AS wait, greatest(1, floor(k * 100 * f + 0.5))::BIGINT AS w, greatest(1, floor(900 * f + 0.5))::BIGINT AS h, (k + 3) // 4 * 3 AS bound
  FROM (SELECT *, CASE WHEN b < 1024 THEN 0 ELSE least(4, floor(log(b) / log(1024) + 1e-12)) END::INTEGER AS p, least(1.0, 1024 / greatest(k * 100, 900)) AS f FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 1000 AS b, o_orderkey % 23 AS k FROM orders))""")
def sizes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("b"), (F.col("o_orderkey") % 23).alias("k"))
    w, h = N.scaled(F.col("k") * 100, F.lit(900), 1024)
    return o.select("o_orderkey", N.human_bytes(F.col("b")).alias("size"), N.percent(F.floor(F.col("k") / 2), F.col("k")).alias("done"), N.backoff(F.col("k"), 2, 60).alias("wait"), w.alias("w"), h.alias("h"), N.base64_bound(F.col("k")).alias("bound"))


_ENDS = ("", ".min.js", "/.ssh/x", "/ID_RSA", "/a.key", "/go.lock", "/.env.example", "/deploy_ed25519.pub", "/.key", "/node_modules/x", ".Bundle.js", "/.ssh")
_PATHS = f"""SELECT page_id, page_id % 12 AS k, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) || {list(_ENDS)}[page_id % 12 + 1] AS path, html FROM pages"""


@query(f"""SELECT page_id, path, k IN (2, 3, 4, 6, 7) AS secret, k IN (1, 10) AS generated, k = 9 AS foreign, CASE WHEN contains(html, chr(0)) THEN 'binary' WHEN regexp_matches(html, '(^|\n)\\s*-----BEGIN[^\n]*PRIVATE KEY') THEN 'secret' WHEN list_max(list_transform(string_split(html, chr(10)), lambda x: strlen(x))) > 2000 THEN 'minified' END AS gate FROM ({_PATHS})""")
def file_gates(spark, sf):
    path = F.concat(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 12).cast("int")))
    p = table(spark, sf, "pages").select("page_id", path.alias("path"), "html")
    return p.select("page_id", "path", P.secret_path(F.col("path")).alias("secret"), P.generated(F.col("path")).alias("generated"), P.foreign_path(F.col("path")).alias("foreign"), P.content_gate(F.col("html"), 2000).alias("gate"))


@query("""SELECT c_custkey, a || '.' || b || '.' || c || '.' || d AS address, a > 255 AS bad, CASE WHEN a <= 255 THEN (a IN (10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR a >= 224) END AS private
  FROM (SELECT c_custkey, [10, 100, 172, 192, 169, 8, 300, 127, 0, 230, 198, 250, 198][c_custkey % 13 + 1] AS a, [168, 16, 64, 254, 127, 128, 31, 32, 19, 51][c_custkey % 10 + 1] AS b, CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE c_custkey % 256 END AS c, c_custkey * 7 % 256 AS d FROM customer)""")
def private_addresses(spark, sf):
    k = F.col("c_custkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int")).cast("string")
    third = F.when(k % 3 == 0, 100).otherwise(k % 256).cast("string")
    text = F.concat_ws(".", pick((10, 100, 172, 192, 169, 8, 300, 127, 0, 230, 198, 250, 198)), pick((168, 16, 64, 254, 127, 128, 31, 32, 19, 51)), third, (k * 7 % 256).cast("string"))
    return table(spark, sf, "customer").select(k, text.alias("address"), P.address(text).isNull().alias("bad"), P.private_address(text).alias("private"))


_GROUPED = ("fe80::{}", "fd00:1::{}:0", "2001:db8::{}", "::{}", "::ffff:10.0.0.{}", "64:ff9b::8.8.8.{}", "1:2:3:4:5:6:7:8:{}", "ff02::{}")


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN d IN ('0', '1') WHEN 4 THEN CASE WHEN o_orderkey % 300 < 256 THEN true END WHEN 5 THEN CASE WHEN o_orderkey % 300 < 256 THEN false END WHEN 7 THEN true END AS private FROM (SELECT o_orderkey, o_orderkey % 8 AS k, (o_orderkey % 300)::VARCHAR AS d FROM orders)""")
def private_groups(spark, sf):
    """Addresses in groups, some of which carry a dotted one; nine groups and numbers over 255 are none."""
    k, d = F.col("o_orderkey"), (F.col("o_orderkey") % 300).cast("string")
    text = F.replace(F.get(F.array(*map(F.lit, _GROUPED)), (k % 8).cast("int")), F.lit("{}"), d)
    return table(spark, sf, "orders").select(k, P.private_address(text).alias("private"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'success' WHEN s IN (408, 425, 429) OR s >= 500 THEN 'retryable' ELSE 'permanent' END AS outcome FROM (SELECT event_id % 500 + 100 AS s FROM events)) GROUP BY 1""")
def http_outcomes(spark, sf):
    return table(spark, sf, "events").groupBy(P.http_outcome(F.col("event_id") % 500 + 100).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, length(t) AS chars, t AS text, array_to_string(n.t2, ',') AS tags FROM (SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || chr(1), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', ' ', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10)), 400) AS t, source, lang FROM documents) d,
  LATERAL (SELECT list_slice(list_sort(list_distinct([x FOR x IN [lower(source), lower(lang), regexp_replace(lower('A b!' || source), '[^a-z0-9\\-_./]', '', 'g')] IF x <> ''])), 1, 2) AS t2) n""")
def sanitized_notes(spark, sf):
    d = table(spark, sf, "documents")
    text = W.sanitized(F.concat("text", F.lit("\r\n\x01")), 400)
    tags = W.tag_set(F.array("source", "lang", F.concat(F.lit("A b!"), "source"), F.lit("!!")), 2)
    return d.select("doc_id", text.alias("text"), F.length(text).cast("bigint").alias("chars"), F.array_join(tags, ",").alias("tags"))


@query("""SELECT doc_id, length(text) > 900 AS cut, CASE WHEN length(text) <= 900 THEN text ELSE rtrim(CASE WHEN gap > 0 AND (gap - 1) * 4 >= 2700 THEN left(text, gap - 1) ELSE left(text, 900) END) END AS head
  FROM (SELECT doc_id, text, 900 - nullif(instr(reverse(left(text, 900)), chr(10) || chr(10)), 0) AS gap FROM documents)""")
def truncated_texts(spark, sf):
    t = W.truncated(F.col("text"), 900)
    return table(spark, sf, "documents").select("doc_id", t["cut"].alias("cut"), t["text"].alias("head"))


@query("""SELECT s_suppkey, 'http://user:***@' || lower(s_name) || '/x' AS url, '--token *** --api-key=*** -v ' || s_name AS arguments FROM supplier""")
def redacted(spark, sf):
    s = table(spark, sf, "supplier")
    url = W.redacted_url(F.concat(F.lit("http://user:p"), F.col("s_suppkey").cast("string"), F.lit("@"), F.lower("s_name"), F.lit("/x")))
    arguments = F.array(F.lit("--token"), "s_name", F.concat(F.lit("--api-key="), "s_name"), F.lit("-v"), F.col("s_name"))
    return s.select("s_suppkey", url.alias("url"), F.array_join(W.redacted_arguments(arguments, P.secret_name), " ").alias("arguments"))


@query("""SELECT doc_id, pos, CASE WHEN s > 1 THEN '…' ELSE '' END || substring(text, s, 60) || CASE WHEN length(text) >= s + 60 THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'licen')::INTEGER AS pos, greatest(instr(lower(text), 'licen') - 20, 1) AS s FROM documents) WHERE pos > 0""")
def snippets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.instr(F.lower("text"), "licen").alias("pos")).where("pos > 0")
    return d.select("doc_id", "pos", W.snippet(F.col("text"), F.col("pos"), 60).alias("snippet"))


@query("""SELECT doc_id, i::INTEGER AS line_no, length(regexp_extract(line, '^(#+)', 1))::INTEGER AS level, trim(regexp_extract(line, '^#+ (.*?)( #+)?$', 1)) AS title FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT doc_id, '# ' || source || ' #' || chr(10) || text || chr(10) || '####### no' || chr(10) || '### ' || lang AS t FROM documents)) WHERE regexp_matches(line, '^#{1,6} +[^# ]')""")
def headings(spark, sf):
    text = F.concat(F.lit("# "), "source", F.lit(" #\n"), "text", F.lit("\n####### no\n### "), "lang")
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.startswith(F.ltrim("line"), F.lit("#")))
    h = W.heading(F.col("line"))
    return lines.where(h.isNotNull()).select("doc_id", (F.col("i") + 1).alias("line_no"), h["level"].alias("level"), h["title"].alias("title"))


@query("""SELECT item_id, len(s)::INTEGER AS n, s[1] AS first, array_to_string(s, '') = text AS whole FROM (SELECT item_id, text, list_filter(string_split_regex(regexp_replace(text, '([.!?\\n]\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM benchmark)""")
def sentence_counts(spark, sf):
    s = W.sentences(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"), (F.array_join(s, "") == F.col("text")).alias("whole"))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, length(regexp_replace(html, '(?s)<[^>]*(>|\\z)', '', 'g')) AS chars, url_encode(url) AS encoded FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", W.title(F.col("html")).alias("title"), F.length(W.without_tags(F.col("html"))).cast("bigint").alias("chars"), W.percent_encoded(F.col("url")).alias("encoded"))


@query("""SELECT l_orderkey, array_to_string(list_slice(p, 1, 3), ', ') || CASE WHEN len(p) > 3 THEN ', +' || len(p) - 3 || ' more' ELSE '' END AS parts FROM (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1)""")
def listed_parts(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    return g.select("l_orderkey", W.listed(F.transform("p", lambda x: x["l_partkey"].cast("string")), 3).alias("parts"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), [p_size + 2, 99]))), ',') AS pages FROM part")
def page_selections(spark, sf):
    n = lambda k: (F.col("p_size") + k).cast("string")
    text = F.concat(n(0), F.lit("-"), n(3), F.lit(", "), n(2), F.lit(",99,x,9-1"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(W.page_numbers(text), lambda x: x.cast("string")), ",").alias("pages"))


@query("""SELECT n, count(*) AS docs FROM (SELECT trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g')), '\\s+', ' ', 'g')) AS t, count(*) AS n FROM conversations GROUP BY 1) GROUP BY n""")
def repeated_turns(spark, sf):
    said = table(spark, sf, "conversations").groupBy(W.for_repeats(F.col("text")).alias("t")).agg(F.count("*").alias("n"))
    return said.groupBy("n").agg(F.count("*").alias("docs"))


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<!--.*?-->|</?(b|a)( [^>]*)?>', '', 'g'), '(?s)<div class="ad">.*?</div>', '<br>', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '\\s+', ' ', 'g'), '</h1>|</p>', chr(2), 'g'), '<p>|<br>', chr(1), 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(replace(h, '<h1>', chr(2) || '# '), '[ \\x01\\x02]*\\x02[ \\x01\\x02]*', chr(10) || chr(10), 'g'), '[ \\x01]*\\x01[ \\x01]*', chr(10), 'g') AS h FROM b)
  SELECT page_id, trim(replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(10)) AS text FROM c""")
def readable_pages(spark, sf):
    return readable(table(spark, sf, "pages").select("page_id", "html"), "html")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*(>|\\z)', '', 'g'), '>', ''), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS snippet FROM pages""")
def clean_snippets(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.cleaned(F.col("html")).alias("snippet"))
