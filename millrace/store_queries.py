"""Queries over event-time ledgers, records that peers send, op-logs, framed logs, budgets in order, robots groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import robots
from .operators import prefix
from .queries import query
from .sources import frames, oplog, staged
from .sources.tables import shared_folder, table
from .streaming import epochs, ingest

_ARRIVED = """a AS (SELECT user_id, event_id, value, event_type, came, date_trunc('hour', came)::TIMESTAMP AS start, max(came) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(came) OVER (PARTITION BY user_id) AS final
  FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 30 HOUR ELSE ts END AS came FROM events)),
e AS (SELECT *, coalesce(start + INTERVAL 1 HOUR <= seen - INTERVAL 6 HOUR, false) AS late, start + INTERVAL 1 HOUR <= final - INTERVAL 6 HOUR AS sealed FROM a),
g AS (SELECT user_id, start, count(*) FILTER (NOT late) AS n, round(coalesce(sum(value) FILTER (NOT late), 0), 4) AS total, count(*) FILTER (late) AS late, bool_or(sealed) AS sealed, coalesce(list_sort(list(DISTINCT event_type) FILTER (NOT late)), []) AS p FROM e GROUP BY ALL)"""


def _epochs(spark, sf):
    """Users as nodes; every eleventh event comes thirty hours after its moment."""
    ts = F.col("ts").cast("timestamp_ntz")
    e = table(spark, sf, "events").withColumn("at", F.when(F.col("event_id") % 11 == 0, ts - F.expr("interval 30 hours")).otherwise(ts))
    return epochs.epochs(epochs.arrived(e, "user_id", ["event_id"], "at", F.expr("interval 6 hours")), "user_id", "value", "event_type", 2)


@query(f"WITH {_ARRIVED} SELECT user_id, start, n, total, late, sealed, array_to_string(p[1:2], ',') AS peers, len(p) > 2 AS more FROM g")
def event_epochs(spark, sf):
    return _epochs(spark, sf).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"), "late", "sealed", F.array_join("peers", ",").alias("peers"), "more")


@query(f"""WITH {_ARRIVED} SELECT user_id, start, n, sealed FROM g WHERE start + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20 10:30:00' AND (sealed OR n > 0)""")
def epochs_in_window(spark, sf):
    """The hour that 10:30 falls in is given whole."""
    rows = epochs.window_rows(_epochs(spark, sf), F.expr("timestamp_ntz'2024-01-20 10:30:00'"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "sealed")


@query(f"""WITH {_ARRIVED}, h AS (SELECT user_id, date_trunc('day', start)::TIMESTAMP AS start, sum(n)::BIGINT AS n, sum(late)::BIGINT AS late, bool_and(sealed) AS sealed, bool_or(len(p) > 2) AS cut, list_sort(list_distinct(flatten(list(p[1:2])))) AS q FROM g GROUP BY ALL)
  SELECT user_id, start, n, late, sealed, array_to_string(q[1:2], ',') AS peers, cut OR len(q) > 2 AS more FROM h""")
def epochs_by_day(spark, sf):
    """Capped sets of hours merged into those of days; once cut, always marked."""
    days = epochs.merged(_epochs(spark, sf), "user_id", F.date_trunc("day", "start"), 2)
    return days.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "late", "sealed", F.array_join("peers", ",").alias("peers"), "more")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS now, event_id % 5 AS note, epoch_us(ts) // 1000000 + floor(value * 3000)::BIGINT AS expires, event_type = 'error' AS empty, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, -1::BIGINT AS event_id, [{'e': 0::BIGINT, 'c': 0::BIGINT, 'k': 0::BIGINT}][1:0] AS notes, 0::BIGINT AS since, 0::BIGINT AS used, '' AS outcome, 0::BIGINT AS evicted FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, n, event_id, CASE WHEN outcome IN ('accepted', 'replaced') THEN mine[greatest(len(mine) - 2, 1):] ELSE live END, since, CASE WHEN outcome = 'rate limited' THEN used ELSE used + 1 END, outcome, CASE WHEN outcome IN ('accepted', 'replaced') THEN greatest(len(mine) - 3, 0) ELSE 0 END FROM (
    SELECT *, CASE WHEN used >= 2 THEN 'rate limited' WHEN empty THEN 'empty' WHEN len(list_filter(live, lambda x: x.k = note)) > 0 THEN 'replaced' ELSE 'accepted' END AS outcome,
      list_sort(list_append(list_filter(live, lambda x: x.k <> note), {'e': now + least(greatest(expires - now, 60), 200000), 'c': now, 'k': note})) AS mine FROM (
      SELECT e.user_id, e.n, e.event_id, e.now, e.note, e.expires, e.empty, list_filter(s.notes, lambda x: x.e > e.now) AS live, CASE WHEN e.now - s.since >= 20000 THEN e.now ELSE s.since END AS since, CASE WHEN e.now - s.since >= 20000 THEN 0 ELSE s.used END AS used
      FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT event_id, outcome, evicted, len(notes) AS held FROM s WHERE n > 0""")
def notes_taken(spark, sf):
    """Users as peers that send notes: two in 20,000 seconds, three held."""
    now = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", now.alias("now"), "event_id", (F.col("event_id") % 5).alias("note"), (now + F.floor(F.col("value") * 3000)).alias("expires"), (F.col("event_type") == "error").alias("empty"))
    return ingest.replayed(rows, "user_id", ["now", "event_id", "note", "expires", "empty"], ingest.note_step(2, 3, 60, 200_000, 20_000), ingest.NOTES).select("event_id", "outcome", "evicted", "held")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS now, event_type AS q, strlen(props) * 10 + event_id % 90 AS size, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN NULL ELSE 40000 END AS own, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, -1::BIGINT AS event_id, [{'q': '', 'b': 0::BIGINT, 'x': 0::BIGINT}][1:0] AS held, '' AS outcome, 0::BIGINT AS evicted FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, n, event_id, mine[1 + go:], outcome, go FROM (
    SELECT *, len(list_filter(range(1, len(mine)), lambda i: len(mine) - i + 1 > 3 OR list_sum(list_transform(mine[i:], lambda x: x.b)) > 450)) AS go FROM (
      SELECT *, CASE WHEN len(list_filter(live, lambda x: x.q = q)) > 0 THEN 'replaced' ELSE 'stored' END AS outcome, list_append(list_filter(live, lambda x: x.q <> q), {'q': q, 'b': size, 'x': CASE WHEN coalesce(own, 90000) > 0 THEN now + coalesce(own, 90000) END}) AS mine FROM (
        SELECT e.user_id, e.n, e.event_id, e.now, e.q, e.size, e.own, list_filter(s.held, lambda x: x.x IS NULL OR x.x > e.now) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))))
SELECT event_id, outcome, evicted, len(held) AS held, list_sum(list_transform(held, lambda x: x.b))::BIGINT AS bytes_held FROM s WHERE n > 0""")
def entries_stored(spark, sf):
    """A cache for each user: answers by their event type, of three entries and 450 bytes at most."""
    k = F.col("event_id") % 4
    own = F.when(k == 0, 0).when(k == 1, None).otherwise(40_000).cast("long")
    size = (F.octet_length("props") * 10 + F.col("event_id") % 90).cast("long")
    rows = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("now"), "event_id", F.col("event_type").alias("query"), size.alias("size"), own.alias("own"))
    return ingest.replayed(rows, "user_id", ["now", "event_id", "query", "size", "own"], ingest.entry_step(3, 450, 90_000), ingest.ENTRIES).select("event_id", "outcome", "evicted", "held", "bytes_held")


def _log(spark, sf):
    """An op-log for each nine users: puts of chunks, deletes, deletes of documents; log 3 has a line of another width, log 4 a line in its midst that can't be read, log 5 is torn."""
    e = table(spark, sf, "events").select((F.col("user_id") % 9).alias("collection"), (F.col("event_id") + 1).alias("line"), "event_type", "event_id", F.floor("value").cast("long").alias("v"))
    ends = e.groupBy("collection").agg(F.max("line").alias("end"))
    e = e.join(ends, "collection")
    c, key, doc = F.col("collection"), F.concat(F.lit("c"), F.col("v").cast("string")), F.concat(F.lit("d"), (F.col("v") % 10).cast("string"))
    put = F.to_json(F.struct(F.lit("put").alias("op"), key.alias("id"), doc.alias("document"), F.lit("m").alias("model"), F.when((c == 3) & (F.col("event_id") % 100 == 7), F.array(F.lit(1.0))).otherwise(F.array(F.col("v").cast("double"), F.lit(0.5))).alias("vector")))
    raw = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("delete").alias("op"), key.alias("id")))).when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("delete_document").alias("op"), doc.alias("document")))).otherwise(put)
    torn = ((c == 5) & (F.col("line") == F.col("end"))) | ((c == 4) & (F.col("event_id") % 200 == 9))
    heads = ends.select("collection", F.lit(0).cast("long").alias("line"), F.lit('{"op":"header","model":"m","width":2}').alias("raw"))
    said = e.withColumn("_raw", raw).select("collection", "line", F.when(torn, F.substring("_raw", 1, 12)).otherwise(F.col("_raw")).alias("raw"))
    return said.union(heads)


_LOG = """l AS (SELECT user_id % 9 AS c, event_id + 1 AS line, event_type AS t, event_id, floor(value)::BIGINT AS v, max(event_id + 1) OVER (PARTITION BY user_id % 9) AS last FROM events),
o AS (SELECT *, CASE WHEN c = 5 AND line = last THEN 'torn' WHEN c = 4 AND event_id % 200 = 9 THEN 'unreadable' WHEN t = 'error' THEN 'delete' WHEN t = 'signup' THEN 'wipe' WHEN c = 3 AND event_id % 100 = 7 THEN 'other width' ELSE 'put' END AS op FROM l),
f AS (SELECT c, min(line) FILTER (op IN ('unreadable', 'other width') AND NOT (op = 'unreadable' AND line = last)) AS error_line, arg_min(op, line) FILTER (op IN ('unreadable', 'other width') AND NOT (op = 'unreadable' AND line = last)) AS error, count(*) + 1 AS lines FROM o GROUP BY c),
p AS (SELECT * FROM (SELECT o.c, v, line, row_number() OVER (PARTITION BY o.c, v ORDER BY line DESC) AS k FROM o JOIN f ON f.c = o.c AND f.error IS NULL WHERE op = 'put') WHERE k = 1),
live AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c = p.c AND o.line > p.line AND (op = 'delete' AND o.v = p.v OR op = 'wipe' AND o.v % 10 = p.v % 10)))"""


@query(f"WITH {_LOG} SELECT c AS collection, 'c' || v AS id, 'd' || v % 10 AS document, line, v::DOUBLE AS first FROM live")
def op_log_chunks(spark, sf):
    return oplog.state(_log(spark, sf))[0].select("collection", "id", "document", "line", F.get("vector", F.lit(0)).alias("first"))


@query(f"WITH {_LOG} SELECT f.c AS collection, lines, CASE WHEN error IS NULL THEN n END AS chunks, CASE WHEN error IS NULL THEN lines - 1 - n END AS dead_lines, error_line, error FROM (SELECT f.*, (SELECT count(*) FROM live WHERE live.c = f.c) AS n FROM f) f")
def op_log_states(spark, sf):
    return oplog.state(_log(spark, sf))[1]


@query(f"""WITH {_LOG}, d AS (SELECT c, 'd' || x AS document, coalesce((SELECT count(*) FROM live WHERE live.c = f.c AND live.v % 10 = x), 0) AS n FROM f, (SELECT unnest([1, 3, 77]) AS x))
  SELECT c AS collection, count(*) FILTER (n > 0) AS documents_deleted, sum(n)::BIGINT AS chunks_deleted FROM d GROUP BY c""")
def documents_deleted(spark, sf):
    """Documents 1, 3 and one that isn't there go from every log."""
    log = _log(spark, sf)
    doomed = log.select("collection").distinct().select("collection", F.explode(F.array(*[F.lit(f"d{x}") for x in (1, 3, 77)])).alias("document"))
    return oplog.delete_documents(log, doomed)[1]


@query(f"""WITH {_LOG}, s AS (SELECT f.*, (SELECT count(*) FROM live WHERE live.c = f.c) AS n FROM f), d AS (SELECT *, error IS NULL AND lines >= 40 AND lines - 1 - n >= 0.3 * lines AS due FROM s)
  SELECT c AS collection, lines AS lines_before, CASE WHEN due THEN n + 1 ELSE lines END AS lines, CASE WHEN error IS NULL THEN n END AS chunks, CASE WHEN due THEN 0 WHEN error IS NULL THEN lines - 1 - n END AS dead_lines, error FROM d""")
def logs_compacted_in_place(spark, sf):
    """The op-logs as a store, appended to twice, compacted and read again."""
    store = staged.log_store(spark, f"{shared_folder(spark)}/millrace-logs-{uuid.uuid4().hex}", 8)
    lines = _log(spark, sf).withColumn("collection", F.col("collection").cast("string"))
    for part in (0, 1):
        store.put(lines.where(F.col("line") % 2 == part), f"lines {part}")
    before = oplog.state(store.rows())[1].select("collection", F.col("lines").alias("lines_before"))
    staged.compact(store, "compact", 40)
    after = oplog.state(store.rows())[1].drop("error_line")
    return after.join(before, "collection").withColumn("collection", F.col("collection").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, strlen(props) + 1 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0, event_id) AS n FROM events),
  w AS (SELECT user_id, n, event_id, bytes, bytes AS size, 0::BIGINT AS g FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, e.bytes, CASE WHEN w.size + e.bytes > 200 THEN e.bytes ELSE w.size + e.bytes END, w.g + (w.size + e.bytes > 200)::BIGINT FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
  SELECT 'u' || user_id AS file, (last - g)::INTEGER AS generation, count(*) AS lines, sum(bytes)::BIGINT AS bytes, min(n) - 1 AS first_line FROM (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM w) WHERE last - g <= 1 GROUP BY ALL""")
def files_rolled_in_place(spark, sf):
    """Events' properties appended to a file for each user in two requests, at most 200 bytes a file, and the files read again."""
    store = staged.file_store(spark, f"{shared_folder(spark)}/millrace-files-{uuid.uuid4().hex}", 8)
    records = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("number"), F.col("props").alias("record"))
    for name, part in (("first", "number % 3 <> 0"), ("second", "number % 3 = 0")):
        staged.append_records(store, records.where(part), name, 200)
    store.clear()
    bytes_ = F.sum(F.octet_length("record") + 1).cast("long")
    return store.rows().groupBy("file", "generation").agg(F.count("*").alias("lines"), bytes_.alias("bytes"), F.min("number").alias("first_line"))


def _bodies(spark, sf):
    """A conversation's turns as the frames of one body: users write to stdout, others to stderr; every third turn ends its line."""
    payload = F.concat("text", F.when(F.col("turn") % 3 == 0, "\n").otherwise("")).cast("binary")
    length = F.unhex(F.lpad(F.hex(F.length("p").cast("long")), 8, "0"))
    frame = F.concat(F.when(F.col("role") == "user", F.lit(b"\x01\x00\x00\x00")).otherwise(F.lit(b"\x02\x00\x00\x00")), length, F.col("p"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", payload.alias("p")).select("conv_id", F.struct("turn", frame.alias("f")).alias("s"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["f"])), "")).alias("body"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, CASE WHEN role = 'user' THEN 'stdout' ELSE 'stderr' END AS stream, text || CASE WHEN turn % 3 = 0 THEN chr(10) ELSE '' END AS p FROM conversations),
w AS (SELECT conv_id, stream, string_agg(p, '' ORDER BY frame) AS whole, min(frame) AS first FROM t WHERE p <> '' GROUP BY ALL),
x AS (SELECT conv_id, stream, first, unnest(string_split(whole, chr(10))) AS text, generate_subscripts(string_split(whole, chr(10)), 1) AS k, len(string_split(whole, chr(10))) AS n FROM w),
c AS (SELECT t.conv_id, t.stream, t.frame, sum(len(p) - len(replace(p, chr(10), ''))) OVER (PARTITION BY t.conv_id, t.stream ORDER BY frame) AS upto FROM t WHERE p <> ''),
y AS (SELECT x.*, CASE WHEN k < n THEN (SELECT min(frame) FROM c WHERE c.conv_id = x.conv_id AND c.stream = x.stream AND upto >= k) END AS done FROM x WHERE k < n OR text <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY done IS NULL, coalesce(done, first), k) - 1 AS i, greatest(count(*) OVER (PARTITION BY conv_id) - 6, 0) AS dropped FROM y)
SELECT conv_id, i::INTEGER AS n, stream, CASE WHEN length(text) > 60 THEN text[:60] || '…' ELSE text END AS text, length(text) > 60 AS cut, dropped FROM z WHERE i >= dropped""")
def framed_lines(spark, sf):
    """The last six lines of each body, cut at 60 characters."""
    return frames.lines(frames.frames(_bodies(spark, sf), "conv_id", "body"), "conv_id", 6, 60).drop("stamp").withColumn("n", F.col("n").cast("int"))


_SEARCH = r"""d AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, text, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS l FROM documents),
h AS (SELECT path, i::INTEGER AS line, t[:200] AS t, sum(1) OVER w AS a, sum(strlen(t[:200])) OVER w AS b FROM (SELECT path, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM d) WHERE regexp_matches(t, '(?i)licen[sc]e|rights') WINDOW w AS (ORDER BY path, i)),
r AS (SELECT path, coalesce(sum(strlen(text)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS read_before, len(l) AS lines FROM d),
s AS (SELECT r.*, coalesce((SELECT max(a) FROM h WHERE h.path < r.path), 0) AS a, coalesce((SELECT max(b) FROM h WHERE h.path < r.path), 0) AS b FROM r),
begun AS (SELECT * FROM s WHERE a < 60 AND b < 6000 AND read_before < 1500000),
got AS (SELECT h.path, h.line, h.t AS text, h.a, h.b, begun.lines FROM h JOIN begun ON begun.path = h.path WHERE h.a - 1 < 60 AND h.b - strlen(h.t) < 6000)"""


def _search(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), "text")
    return prefix.budgeted_hits(d, "path", "text", "(?i)licen[sc]e|rights", 60, 6000, 1_500_000, range_rows=5000)


@query(f"WITH {_SEARCH} SELECT path, line, text FROM got")
def budgeted_search(spark, sf):
    """Sixty hits, 6,000 bytes of them, 1.5 MB read: whatever comes first in order of path."""
    return _search(spark, sf)[0]


@query(f"WITH {_SEARCH} SELECT (SELECT count(*) FROM begun) AS files_read, (SELECT count(*) FROM got) AS hits, (SELECT count(*) FROM begun) < (SELECT count(*) FROM d) OR coalesce((SELECT bool_or(line < lines) FROM got WHERE a >= 60 OR b >= 6000), false) AS truncated")
def budgeted_search_status(spark, sf):
    return _search(spark, sf)[1]


@query("SELECT event_id, coalesce(sum(v) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT event_id, ts, floor(value)::BIGINT AS v FROM events)")
def sums_before_all(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.floor("value").cast("long").alias("v"))
    return prefix.sums_before(e, ["ts", "event_id"], {"before": F.col("v")}, 3000).select("event_id", "before")


@query("""SELECT k AS event_type, floor((min(v) + max(v)) / 2)::BIGINT AS median, max(v) AS upper FROM (SELECT event_type AS k, floor(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 100)) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  WHERE r = (n + 1) // 2 OR r = n // 2 + 1 GROUP BY 1""")
def medians_in_levels(spark, sf):
    return prefix.medians(table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 100).alias("v")), "event_type", "v")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, sum(s) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS kept FROM (SELECT *, o_orderkey % 1000 AS s FROM orders)) WHERE kept > 200000""")
def evicted_in_levels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 1000).alias("size"))
    return prefix.evicted(o, "o_orderpriority", "o_orderdate", "o_orderkey", "size", 200_000, 4000)


_SITE = "regexp_extract(url, '^[a-z]+://(?:[^/]*\\.)?([a-z-]+\\.[a-z]+)/', 1)"
# What a page's line says in the robots.txt of its site, by the page's number modulo ten.
_SAYS = ["User-agent: *", "Disallow: /en/ # not there", "user-agent: OtherBot", "User-Agent: MillBot", "Allow: /en/1*", "Disallow: /*5$", "Crawl-delay: 4", "Disallow: fr", "Disallow:", "nothing to say"]


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1) AS path, page_id % 10 AS m FROM pages),
s AS (SELECT *, lag(m) OVER (PARTITION BY site ORDER BY page_id) IN (0, 2, 3) AS after_name FROM p WHERE m NOT IN (6, 9)),
g AS (SELECT *, sum(CASE WHEN m IN (0, 2, 3) AND NOT coalesce(after_name, false) THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY page_id) AS g FROM s),
w AS (SELECT *, max(CASE m WHEN 3 THEN 2 WHEN 0 THEN 1 ELSE 0 END) OVER (PARTITION BY site, g) AS whose FROM g),
r AS (SELECT DISTINCT site, m FROM (SELECT *, max(whose) OVER (PARTITION BY site) AS best FROM w WHERE m NOT IN (0, 2, 3) AND whose > 0) WHERE whose = best AND m <> 8),
v(m, allow, len, rx) AS (VALUES (1, false, 4, '^/en/'), (4, true, 6, '^/en/1'), (5, false, 4, '^/.*5$'), (7, false, 3, '^/fr'))
SELECT page_id, CASE WHEN coalesce(arg_max(allow, len * 2 + allow::INTEGER) FILTER (regexp_matches(path, rx)), true) THEN 'allow' ELSE 'disallow' END AS verdict FROM p LEFT JOIN (SELECT site, v.* FROM r JOIN v ON v.m = r.m) x ON x.site = p.site GROUP BY page_id""")
def robots_by_group(spark, sf):
    """The pages of a site write its robots.txt, a line each, and are judged by the group for one agent."""
    site = F.regexp_extract("url", r"^[a-z]+://(?:[^/]*\.)?([a-z-]+\.[a-z]+)/", 1)
    p = table(spark, sf, "pages").select("page_id", site.alias("site"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)", 1).alias("path"), F.get(F.array(*map(F.lit, _SAYS)), (F.col("page_id") % 10).cast("int")).alias("raw"))
    return robots.verdicts(p.select("page_id", "site", "path"), "page_id", "site", "path", robots.rules(p, "site", "page_id", "raw", "millbot"))
