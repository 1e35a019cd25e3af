"""Event-time ledgers, records of peers, op-logs, framed logs, budgets, robots groups: edges, and streams against replays."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates, robots, text, writing
from millrace.operators import naming, prefix
from millrace.sources import frames, oplog
from millrace.streaming import epochs, ingest

T0 = datetime(2024, 5, 1, 10, 0)
BIG = (1 << 60) + 1


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def as_set(df, *columns):
    return {tuple(tuple(v) if isinstance(v := r[c], list) else v for c in columns) for r in df.collect()}


# event time


@pytest.fixture
def sent(spark):
    rows = [(1, 1, at(5), 1.0, "a"), (1, 2, at(59), 2.0, "b"), (1, 3, at(200), 4.0, "c"), (1, 4, at(30), 8.0, "z"), (1, 5, at(140), 16.0, None), (BIG, 6, at(1), 1.0, "a"), (None, 7, at(3), 1.0, "q"), (1, 8, None, 1.0, "n")]
    return spark.createDataFrame(rows, "node long, seq long, came timestamp, v double, peer string")


def test_epochs_seal_and_count_late_events(sent):
    e = epochs.epochs(epochs.arrived(sent, "node", ["seq"], "came", F.expr("interval 1 hour")), "node", "v", "peer", 1)
    got = as_set(e, "node", "start", "n", "total", "late", "sealed", "peers", "more")
    assert got == {(1, at(0), 2, 3.0, 1, True, ("a",), True), (1, at(180), 1, 4.0, 0, False, ("c",), False), (1, at(120), 1, 16.0, 0, False, (), False), (BIG, at(0), 1, 1.0, 0, False, ("a",), False), (None, at(0), 1, 1.0, 0, False, ("q",), False)}
    since = as_set(epochs.window_rows(e, F.lit(at(170)).cast("timestamp")), "node", "start")
    assert since == {(1, at(180)), (1, at(120))}
    day = epochs.merged(e, "node", F.date_trunc("day", "start"), 2)
    assert as_set(day.where("node = 1"), "n", "total", "late", "sealed", "peers", "more") == {(4, 23.0, 1, False, ("a", "c"), True)}
    assert epochs.epochs(epochs.arrived(sent.limit(0), "node", ["seq"], "came", F.expr("interval 1 hour")), "node", "v", "peer").count() == 0


def test_capped_sets_merge_in_any_grouping(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(6), f"p{rng.randrange(40):02d}") for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, part long, peer string")
    whole = as_set(epochs.capped_sets(df, ["k"], "peer", 7), "k", "items", "more")
    parts = epochs.capped_sets(df, ["k", "part"], "peer", 7)
    again = epochs.capped_sets(parts.select("k", F.explode("items").alias("peer")), ["k"], "peer", 7)
    assert as_set(again, "k", "items", "more") == whole == {(k, tuple(sorted({p for a, _, p in rows if a == k})[:7]), True) for k in range(4)}


def test_stream_of_epochs_equals_the_batch(spark, tmp_path):
    """In order, sealed hours are those of the batch; an event behind the watermark is dropped and counted."""
    events = [(i % 2, i, at(7 * i), float(i), f"p{i % 3}") for i in range(60)]
    late = [(0, 1000, at(2), 99.0, "late")]
    schema = "node long, seq long, came timestamp, v double, peer string"
    for k, rows in enumerate([events[:20], events[20:40], events[40:], late, [(0, 2000, at(3000), 0.0, "end")], [(0, 2001, at(3001), 0.0, "end")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(6):  # files are taken in the order of their age
        for f in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = epochs.sealed_stream(stream, "node", "came", "v", "peer", "30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = as_set(epochs.folded(spark.read.parquet(f"{tmp_path}/out"), "node", "peer", 2), "node", "start", "n", "total", "peers", "more")
    batch = epochs.epochs(epochs.arrived(spark.createDataFrame(events, schema), "node", ["seq"], "came", F.expr("interval 30 minutes")), "node", "v", "peer", 2)
    assert got == as_set(batch, "node", "start", "n", "total", "peers", "more")
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]) == 1


# records of peers


def test_notes_by_hand(spark):
    rows = [(1, 100, 1, "a", 1000, False), (1, 101, 2, "a", 900, False), (1, 102, 3, "b", 300, False), (1, 130, 4, "c", 10**9, False), (1, 161, 5, "d", 0, True), (1, 162, 6, "d", 0, False), (1, 300, 7, "e", 500, False), (None, 5, BIG, "x", 9, False), (None, 6, None, "x", 9, False)]
    df = spark.createDataFrame(rows, "peer long, now long, event long, note string, expires long, empty boolean").coalesce(1)
    got = ingest.replayed(df, "peer", ["now", "event", "note", "expires", "empty"], ingest.note_step(3, 2, 60, 2000), ingest.NOTES)
    assert as_set(got, "peer", "event", "outcome", "evicted", "held") == {
        (1, 1, "accepted", 0, 1), (1, 2, "replaced", 0, 1), (1, 3, "accepted", 0, 2), (1, 4, "rate limited", 0, 2), (1, 5, "empty", 0, 2), (1, 6, "accepted", 1, 2), (1, 7, "accepted", 0, 2), (None, BIG, "accepted", 0, 1), (None, None, "replaced", 0, 1),
    }
    assert as_set(got.where("event = 6"), "held") == {(2,)}


def test_streams_of_records_equal_replays(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 5, 1000 + 9 * i, BIG + i, f"n{rng.randrange(6)}", 1000 + 9 * i + rng.randrange(500), rng.random() < 0.1, rng.choice([None, 0, 50, 400]), rng.randrange(200)) for i in range(300)]
    schema = "peer long, now long, event long, note string, expires long, empty boolean, own long, size long"
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    whole = spark.createDataFrame(rows, schema)
    for name, columns, step, said in (("notes", ["now", "event", "note", "expires", "empty"], ingest.note_step(3, 3, 60, 300), ingest.NOTES), ("entries", ["now", "event", "note", "size", "own"], ingest.entry_step(3, 400, 200), ingest.ENTRIES)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = ingest.streamed(stream, "peer", columns, step, said, 3_600_000).writeStream.format("memory").queryName(f"of_{name}").option("checkpointLocation", f"{tmp_path}/c{name}").start()
        until = time.time() + 60
        while spark.table(f"of_{name}").count() < len(rows) and time.time() < until:
            time.sleep(0.5)  # batches go on for ever, as states may time out
        q.stop()
        kept = ["peer", "event", *(c.split()[0] for c in said.split(", "))]
        assert as_set(spark.table(f"of_{name}"), *kept) == as_set(ingest.replayed(whole, "peer", columns, step, said), *kept)


# op-logs


def log(spark, **logs):
    rows = [(c, i, line if isinstance(line, str) or line is None else json.dumps(line)) for c, lines in logs.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "collection string, line long, raw string")


HEAD = {"op": "header", "model": "m", "width": 2}


def kept(df):
    """df as a table of its own, as a log that is appended to is one."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def put(i, d, model="m", vector=(1.0, 2.0)):
    return {"op": "put", "id": i, "document": d, "model": model, "vector": list(vector)}


def test_logs_are_replayed_or_spoilt(spark):
    lines = log(
        spark,
        good=[HEAD, put("a", "x"), put("b", "x"), {"op": "delete_document", "document": "x"}, put("b", "x"), put("c", "y"), put("c", "z"), {"op": "delete_document", "document": "y"}, put("d", "y"), {"op": "delete", "id": "d"}, {"op": "delete", "id": "none"}, '{"op":"pu'],
        twice=[HEAD, put("a", "x"), HEAD], headless=[put("a", "x")], garbled=["{", put("a", "x")], middle=[HEAD, "nonsense", put("a", "x"), HEAD], model=[HEAD, put("a", "x", "other")], width=[HEAD, put("a", "x", vector=(1.0,))], empty=[HEAD], unknown=[HEAD, {"op": "what"}, put("a", "x")], null=[HEAD, None, put("a", "x")], short=[HEAD, {"op": "put", "id": "q"}, put("a", "x")],
    )
    chunks, logs = oplog.state(lines)
    assert as_set(chunks, "collection", "id", "document", "line") == {("good", "b", "x", 4), ("good", "c", "z", 6)}
    assert as_set(logs, "collection", "lines", "chunks", "dead_lines", "error_line", "error") == {
        ("good", 12, 2, 9, None, None), ("empty", 1, 0, 0, None, None), ("twice", 3, None, None, 2, "second header"), ("headless", 1, None, None, 0, "no header"), ("garbled", 2, None, None, 0, "unreadable header"), ("middle", 4, None, None, 1, "unreadable"),
        ("model", 2, None, None, 1, "other model"), ("width", 2, None, None, 1, "other width"), ("unknown", 3, None, None, 1, "unreadable"), ("null", 3, None, None, 1, "unreadable"), ("short", 3, None, None, 1, "unreadable"),
    }


def test_documents_are_deleted_and_logs_compacted(spark):
    lines = log(spark, one=[HEAD, put("a", "x"), put("b", "x"), put("c", "y")], two=[HEAD, put("a", "z")], bad=[HEAD, "?", put("a", "x")])
    doomed = spark.createDataFrame([("one", "x"), ("one", "x"), ("one", "gone"), ("two", "gone"), ("nowhere", "x")], "collection string, document string")
    more, outcome = oplog.delete_documents(lines, doomed)
    assert as_set(outcome, "collection", "documents_deleted", "chunks_deleted") == {("one", 1, 2), ("two", 0, 0)}
    assert as_set(more, "collection", "line") == {("one", 4)}
    after = kept(lines.union(more))
    assert as_set(oplog.state(after)[0], "collection", "id") == {("one", "c"), ("two", "a")}
    small = kept(oplog.compacted(after))
    assert as_set(oplog.state(small)[1], "collection", "lines", "chunks", "dead_lines", "error") == {("one", 2, 1, 0, None), ("two", 2, 1, 0, None), ("bad", 3, None, None, "unreadable")}
    assert as_set(oplog.state(small)[0], "collection", "id", "document") == {("one", "c", "y"), ("two", "a", "z")}


# framed logs


def frame(stream, payload):
    return bytes([stream, 0, 0, 0]) + len(payload).to_bytes(4, "big") + payload


def test_lines_over_frames(spark):
    body = frame(1, b"one ") + frame(2, b"err\nhalf") + frame(1, b"two ") + frame(1, "thrée\r\nfour\n\n".encode()) + frame(2, b" done\r\n") + frame(1, b"tail")
    rows = [(1, body), (2, b"no frames here\nat all"), (3, b""), (4, None), (5, frame(1, b"ok\n") + b"\x09junk bytes\n"), (6, frame(1, b"cut short")[:12]), (7, b"\x01\x00"), (8, frame(1, b"x\n") + b"\x01\x00"), (9, frame(1, b"\xc3") + frame(1, b"\n"))]
    df = spark.createDataFrame(rows, "id long, body binary")
    got = frames.lines(frames.frames(df, "id", "body"), "id", 100, 6)
    assert [(r["stream"], r["text"], r["cut"]) for r in got.where("id = 1").orderBy("n").collect()] == [("stderr", "err", False), ("stdout", "one tw…", True), ("stdout", "four", False), ("stdout", "", False), ("stderr", "half d…", True), ("stdout", "tail", False)]
    assert as_set(got.where("id in (2, 5, 6, 7, 8, 9)"), "id", "n", "stream", "text") == {(2, 0, "merged", "no fra…"), (2, 1, "merged", "at all"), (5, 0, "stdout", "ok"), (5, 1, "merged", "\tjunk …"), (6, 0, "stdout", "cut "), (7, 0, "merged", "\x01\x00"), (8, 0, "stdout", "x"), (9, 0, "stdout", "�")}
    tail = frames.lines(frames.frames(df, "id", "body"), "id", 2, 50)
    assert as_set(tail.where("id = 1"), "n", "text", "dropped") == {(4, "half done", 4), (5, "tail", 4)}
    tty = frames.frames(df.where("id = 1"), "id", "body", F.lit(True))
    assert as_set(tty, "frame", "stream") == {(0, "merged")}


def test_stamps_are_split_off(spark):
    rows = [(1, 0, "stdout", b"2024-05-01T10:00:00.000000000Z hello\n2024-05-01 plain\nshort Z x\n2024-05-01T10:00:00+00:00 there you are\n")]
    got = frames.lines(spark.createDataFrame(rows, "id long, frame long, stream string, payload binary"), "id", 9, 99, timestamps=True)
    assert [(r["stamp"], r["text"]) for r in got.orderBy("n").collect()] == [("2024-05-01T10:00:00.000000000Z", "hello"), (None, "2024-05-01 plain"), (None, "short Z x"), ("2024-05-01T10:00:00+00:00", "there you are")]


# sums in order


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_sums_before(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, "a", "b", "ñ"]), i, rng.choice([None, 1, 5, BIG // 2000])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    total, want = 0, set()
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want.add((k, i, total))
        total += v or 0
    assert as_set(prefix.sums_before(df, ["k", "i"], {"before": F.col("v")}, size), "k", "i", "before") == want
    assert prefix.sums_before(df.limit(0), ["k", "i"], {"before": F.col("v")}).count() == 0


def test_ranges_are_bounded_in_number(spark):
    """Short ranges of many rows grow longer instead of more, and their numbers follow the order, nulls first."""
    rows = spark.range(4000).selectExpr("if(id % 7 = 0, null, hash(id) / 3e5D) as x", "id")
    at = rows.withColumn("r", prefix.ranges(rows, ["x", "id"], 1)).orderBy("x", "id").collect()
    numbers = [r["r"] for r in at]
    assert numbers == sorted(numbers) and 100 < len(set(numbers)) <= 256


def test_evicted_of_groups_that_share_ranges(spark):
    rows = [(g, i * 37 % 50, i, i % 9) for i in range(600) for g in (["a", "b", None][i % 3],)]
    got = prefix.evicted(spark.createDataFrame(rows, "g string, used long, i long, size long"), "g", "used", "i", "size", 100, 1)
    want = set()
    for g in ("a", "b", None):
        kept = 0
        for _, _, i, size in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3], reverse=True):
            kept += size
            want |= {(g, i)} if kept > 100 else set()
    assert as_set(got, "g", "i") == want


def test_medians_of_counts(spark):
    rows = [("a", v) for v in (5, 1, 3)] + [("b", v) for v in (4, 1, 4, 9)] + [("c", None), (None, 7), (None, 10)] + [("d", 2)] * 50
    got = prefix.medians(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    assert as_set(got, "k", "median", "upper") == {("a", 3, 3), ("b", 4, 4), (None, 8, 10), ("d", 2, 2)}


def searched(files, most_hits, most_payload, most_scanned):
    """One file after another, as a reader would."""
    hits, paid, read, begun, cut = [], 0, 0, 0, False
    for path, body in sorted(files):
        if len(hits) >= most_hits or paid >= most_payload or read >= most_scanned:
            cut = True
            break
        begun += 1
        read += len(body.encode())
        for n, line in enumerate(body.splitlines(), 1):
            if len(hits) >= most_hits or paid >= most_payload:
                cut = True
                break
            if "x" in line:
                paid += len(line.encode())
                hits.append((path, n, line))
    return set(hits), (begun, len(hits), cut)


def test_budgets_end_a_search_where_a_reader_would(spark):
    rng = random.Random(8)
    files = [(f"f{i:03d}", "".join(rng.choice(["a", "x", "ñ", "\n", "\n"]) for _ in range(rng.randrange(60))) + "end") for i in range(80)]
    df = spark.createDataFrame([*files, ("f999", None)], "path string, body string").repartition(4)
    for bounds in ((5, 10**6, 10**6), (10**6, 40, 10**6), (10**6, 10**6, 300), (10**6, 10**6, 10**6), (1, 1, 1), (30, 200, 900)):
        hits, status = prefix.budgeted_hits(df, "path", "body", "x", *bounds, range_rows=9)
        want, told = searched(files, *bounds)
        assert as_set(hits, "path", "line", "text") == want and tuple(status.first()) == told, bounds


# robots and small ones


def test_robots_groups(spark):
    body = "disallow: /before-any\nUser-agent: other\nUser-agent: Mill # me\nDisallow: /a*b$\n\nCrawl-delay: 1\nAllow: x\nUser-agent: *\nDisallow: /\nuser-agent: mill\nDisallow: /second\nno colon\n"
    sites = {"named": body, "star": "User-agent: *\nDisallow: /p\nUser-agent: other\nDisallow: /\n", "free": "User-agent: mill\nDisallow:\nUser-agent: *\nDisallow: /\n", "allow-only": "User-agent: mill\nAllow:\nUser-agent: *\nDisallow: /q\n", "none": "Sitemap: x\n"}
    lines = spark.createDataFrame([(s, i, x) for s, b in sites.items() for i, x in enumerate(b.split("\n"))], "site string, line long, raw string")
    held = robots.rules(lines, "site", "line", "raw", "MILL")
    assert as_set(held, "site", "pattern", "allow") == {("named", "/a*b$", False), ("named", "/x", True), ("named", "/second", False), ("star", "/p", False), ("allow-only", "/q", False)}
    asked = [("named", "/a/c/b"), ("named", "/a/c/bd"), ("named", "/secondary"), ("star", "/p.html"), ("free", "/anything"), ("allow-only", "/q"), ("none", "/"), ("unseen", "/")]
    paths = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(asked)], "id long, site string, path string")
    got = {r["id"]: r["verdict"] for r in robots.verdicts(paths, "id", "site", "path", held).collect()}
    assert [got[i] == "allow" for i in range(len(asked))] == [False, True, False, False, True, False, True, True]


def test_addresses_pages_keys_and_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(predicates.address(F.lit(a))) for a in ("1.2.3.4", "1.2.3.4.", "1.2.3", "1.2.3.4\n", "1.2.3.256", "x", "")] == [16909060, None, None, None, None, None, None]
    assert one(writing.page_numbers(F.lit("99999999999-3, 3-1, 2-4,7, 99999999999999999999"), 9)) == [2, 3, 4, 7] and one(writing.page_numbers(F.lit("1-2000000000"), 3)) == [1, 2, 3]
    keys = [one(text.joined_key(*map(F.lit, p))) for p in (("a", "b"), ("ab", ""), ("a:1:b", ""), ("", "ab"))] + [one(text.joined_key(F.lit(None).cast("string"), F.lit("ab")))]
    assert len(set(keys)) == 5
    rows = [(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "a_2"), (6, "a_02"), (7, "a_2_2"), (8, "b")]
    got = naming.distinct_names(spark.createDataFrame(rows, "k long, base string"), "k", "base")
    assert as_set(got, "k", "name") == {(1, "a"), (2, "a_3"), (3, "a_2"), (4, "a_4"), (5, "a_2_3"), (6, "a_02"), (7, "a_2_2"), (8, "b")}
