"""Every query with SQL gives DuckDB's rows."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import cron
from millrace.functions.chunks import passages
from millrace.functions.text import path_glob
from millrace.operators import vectors
from millrace.plans.guard import guarded, refusal
from millrace.registry import ORACLE_SQL, QUERIES
from millrace.streaming import throttle

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 4)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_throttle_of_one_key_at_one_a_second(spark):
    events = spark.range(400).selectExpr("1L as user_id", "id as event_id", "timestamp_seconds(id) as ts")
    got = throttle.throttled(events, 10_000).collect()
    assert len(got) == 40
    assert sorted(r["suppressed"] for r in got) == [0] + [9] * 39


def test_bucket_refuses_the_fourth(spark):
    events = spark.createDataFrame([(1, i, 0) for i in range(4)] + [(1, 4, 20)], "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) as ts")
    got = {r["event_id"]: (r["admitted"], r["retry_ms"]) for r in throttle.rate_limited(events, 3, 60_000).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, 20_000), 4: (True, 0)}


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("five")
    df, cut = guarded(spark, "SELECT id FROM five", 3)
    assert df.count() == 3 and cut.first()["truncated"]
    assert not guarded(spark, "SELECT id FROM five", 5)[1].first()["truncated"] and not guarded(spark, "SELECT id FROM five")[1].first()["truncated"]
    assert [r["id"] for r in guarded(spark, "SELECT id FROM five ORDER BY id DESC", 2)[0].collect()] == [4, 3]
    spark.range(3).write.mode("overwrite").saveAsTable("secret_table")
    for bad in (
        "DROP VIEW five", "CREATE TABLE x AS SELECT 1", "nonsense", "SET a=b", "WITH x AS (SELECT 99L AS id) INSERT INTO five SELECT * FROM x", "INSERT INTO five VALUES (1)", "REFRESH TABLE five",
        "ANALYZE TABLE five COMPUTE STATISTICS", "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/x`", "SELECT reflect('java.lang.System', 'exit')", "SELECT id FROM five WHERE id IN (SELECT * FROM csv.`/x`)",
        "WITH secret_table AS (SELECT * FROM secret_table) SELECT * FROM secret_table", "WITH a AS (SELECT * FROM secret_table), secret_table AS (SELECT 1 AS x) SELECT * FROM a",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM IDENTIFIER('secret_table')", "SELECT input_file_name() FROM five", "SELECT current_user()", "SELECT * FROM five WHERE id IN (SELECT id FROM secret_table)",
        "SELECT EXISTS (SELECT * FROM secret_table)", "SELECT * FROM five JOIN LATERAL (SELECT * FROM secret_table)", "SELECT transform(array(1), x -> java_method('java.lang.System', 'getenv'))", "SELECT version()", "SELECT max(id) OVER (ORDER BY reflect('a', 'b')) FROM five",
        "SELECT (SELECT max(id) FROM other)", "SHOW TABLES", "SELECT id FROM five; SELECT 1", "FROM five INSERT OVERWRITE five SELECT *", "SELECT * FROM five UNION SELECT * FROM json.`/x`", "WITH a AS (SELECT * FROM orc.`/x`) SELECT * FROM a",
    ):
        assert refusal(spark, bad), bad
    for good in ("SELECT 'reflect('", "WITH a AS (SELECT id FROM five), b AS (SELECT id + 1 AS i FROM a) SELECT * FROM b WHERE EXISTS (SELECT 1 FROM five WHERE id = i)", "SELECT count(*) OVER () FROM five ORDER BY 1 LIMIT 2 OFFSET 1", "SELECT * FROM (VALUES (1), (2)) AS t(x) JOIN five ON x = id"):
        assert refusal(spark, good) is None, good
        guarded(spark, good)
    assert guarded(spark, "SELECT id FROM five WHERE id < :most", 9, {"most": 2})[0].count() == 2
    recursive = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 4) SELECT sum(n) AS s FROM t"
    assert guarded(spark, recursive)[0].first()["s"] == 10
    spark.sql("DROP TABLE secret_table")
    with pytest.raises(PermissionError):
        guarded(spark, "DROP VIEW five")


def test_streams_equal_replay(spark, tmp_path):
    events = spark.range(0, 300).selectExpr("id % 7 as user_id", "id as event_id", "timestamp_millis(1700000000000 + id * 1700) as ts")
    for k in range(3):
        events.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for name, stream, batch in (("t", throttle.throttled_stream(_stream(spark, tmp_path), 30_000), throttle.throttled(events, 30_000)), ("b", throttle.rate_limited_stream(_stream(spark, tmp_path), 2, 60_000), throttle.rate_limited(events, 2, 60_000))):
        q = stream.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", f"{tmp_path}/c{name}").start()
        want, until = sorted(map(tuple, batch.collect())), time.time() + 90
        while spark.table(f"stream_{name}").count() < len(want) and time.time() < until:
            time.sleep(0.5)  # batches go on for ever, as states may time out
        q.stop()
        assert sorted(map(tuple, spark.table(f"stream_{name}").collect())) == want


def _stream(spark, tmp_path):
    return spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_vectors_out_of_order(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, []), (7, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    assert [(r["vec_id"], r["score"]) for r in vectors.top_k(frame, [1.0, 0.0], 9).collect()] == [(0, 1.0), (5, 1.0), (7, 0.0)]
    assert [r["vec_id"] for r in vectors.top_k(frame, [1.0, 0.0], 9, min_score=0.5).collect()] == [0, 5]
    assert [r["n"] for r in frame.orderBy("vec_id").select(vectors.normalized(F.col("embedding")).alias("n")).collect()] == [[1.0, 0.0], None, None, [1.0], None, [1.0, 0.0], None, [0.0, 1.0]]


def cached(rows, ratio, threshold=0.5):
    """Every lookup (id divisible by 3) against every other row of its bucket and width."""
    out = {}
    for q, b, v, size in rows:
        for e, c, w, other in rows if q is not None and q % 3 == 0 and b is not None else ():
            if e is None or e == q or b != c or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            dot = lambda x, y: sum((s * t for s, t in zip(x, y)), 0.0)
            below = math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))
            score = dot(v, w) / below if below > 0 else math.nan
            if not math.isnan(score):
                out[q] = max(out.get(q, (-2.0, 0, 0)), (float(f"{max(-1.0, min(1.0, score)):.6f}"), -e, other))
    sizes = {r[0]: r[3] for r in rows}
    return {(q, -e, s, s >= threshold and (not ratio or max(sizes[q], o) <= ratio * min(sizes[q], o))) for q, (s, e, o) in out.items()}


@pytest.mark.parametrize("ratio, block", [(None, 16_384), (2.0, 16_384), (2.0, 7)])
def test_nearest_entries_by_brute_force(spark, monkeypatch, ratio, block):
    """Copies, near ties below the sixth digit, other widths, hidden and odd values, in blocks of any size."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)], rng.randrange(1, 9)) for i in range(150)]
    rows += [(200 + i, "c", [1.0, 1e-7 * (i % 5), 0.0], 3) for i in range(40)]
    rows += [(300, "a", [0.0, 0.0, 0.0], 1), (303, "a", None, 1), (306, "a", [], 1), (309, "a", [1.0, None, 2.0], 1), (312, "a", [float("nan"), 1.0, 1.0], 1), (315, "a", [float("inf"), 1.0, 0.0], 1), (318, "a", [1.0, 2.0], 1), (319, "a", [2.0, 1.0], 1), (None, "a", [1.0, 1.0, 1.0], 1), (321, None, [1.0, 1.0, 1.0], 1), (324, "alone", [1.0], 1)]
    rows += [(330, "d", [1e-200, 0.0, 0.0], 1), (333, "d", [1e200, 0.0, 1e10], 1), (336, "d", [1e-120, 1e-121, 0.0], 1), (337, "d", [1.0, 0.1, 0.0], 1), (339, "d", [1e150, 1e150, 0.0], 1)]
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "FEW", 40)
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>, size int").repartition(3)
    got = vectors.nearest(frame.where("vec_id % 3 = 0"), frame, "label", 0.5, ratio=ratio)
    assert "zip_with(q" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair of vectors is multiplied on its own
    assert {tuple(r) for r in got.collect()} == cached(rows, ratio)


def test_lookups_of_a_cache_multiply_no_pair_on_its_own(spark):
    assert "zip_with(q" not in QUERIES["cache_lookup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_path_globs(spark):
    paths = spark.createDataFrame([("src/a.rs",), ("src/deep/b.rs",), ("a.py",), ("src/c1.rs",)], "p string")
    hits = lambda g: sorted(r["p"] for r in paths.where(path_glob(F.col("p"), g)).collect())
    assert hits("*.rs") == ["src/a.rs", "src/c1.rs", "src/deep/b.rs"] and hits("src/*.rs") == ["src/a.rs", "src/c1.rs"] and hits("src/**/*.rs") == ["src/a.rs", "src/c1.rs", "src/deep/b.rs"]
    assert hits("?.py") == ["a.py"] and hits("c[0-9].rs") == ["src/c1.rs"] and hits("[!a].rs") == ["src/deep/b.rs"]


@pytest.mark.parametrize("schedule, at, want", [
    ("5/20 * * * *", "2024-03-04 08:06:00", "2024-03-04 08:25:00"),
    ("0 8-14/2 * * *", "2024-03-04 09:00:00", "2024-03-04 10:00:00"),
    ("0 0 29 2 *", "2024-02-29 00:00:30", "2028-02-29 00:00:00"),
    ("59 23 31 12 *", "2024-12-31 23:58:59", "2024-12-31 23:59:00"),
    ("0 12 13 * 5", "2024-09-12 12:00:00", "2024-09-13 12:00:00"),
    ("0 12 13 * 5", "2024-09-13 12:00:00", "2024-09-20 12:00:00"),
    ("0 0 30 2 *", "2024-01-01 00:00:00", None),
    ("@weekly", "2024-03-04 08:06:00", "2024-03-10 00:00:00"),
    ("30 9 * Feb-Mar Mon-Fri", "2024-03-29 09:30:00", "2025-02-03 09:30:00"),
])
def test_schedule(spark, schedule, at, want):
    row = cron.next_runs(spark.createDataFrame([(at,)], "at string").selectExpr("cast(at as timestamp) as at"), "at", schedule).selectExpr("cast(next_run as string) as n").first()
    assert row["n"] == want


def test_bad_fields():
    for bad in ("60", "5-1", "*/0", "?", "L"):
        with pytest.raises(ValueError):
            cron.field(bad, 0, 59)


def test_passages_of_a_text():
    long = " ".join(f"Sentence number {i} says a little." for i in range(40))
    text = f"# Top\n\nIntro words here.\n\n## Part one\n\n{long}\n\n```python\n# no heading\n\nx = 1\n```\n\nSub\n---\nTail paragraph.\n\n### Last"
    got = passages(text, 400, 80, 500)
    assert all(len(p["text"]) <= 500 for p in got)
    assert got[0]["text"] == "# Top\n\nIntro words here." and got[0]["breadcrumb"] == "Top"
    assert got[1]["text"].startswith("Sentence number 0") and got[1]["breadcrumb"] == "Top > Part one" and got[1]["split"] == "sentence"
    fence = next(p for p in got if "x = 1" in p["text"])
    assert "```python\n# no heading\n\nx = 1\n```" in fence["text"]
    assert got[-1]["text"].endswith("Sub\n---\n\nTail paragraph.\n\n### Last")
    assert {f"Sentence number {i} says a little." for i in range(40)} <= {s + "." for p in got for s in re.findall(r"Sentence number \d+ says a little", p["text"])}
    assert passages(None) == passages(" \n\n ") == [] and [p["split"] for p in passages("x" * 300, 64, 0, 100)] == ["cut", "cut", "word"]
    with pytest.raises(ValueError):
        passages("a", 100, 100, 200)


def test_passages_keep_all_words(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["document_chunks"](spark, SF).orderBy("doc_id", "chunk_no").collect():
        assert 0 < len(r["text"]) <= 2400 and r["first_line"] <= r["last_line"]
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in docs.items():
        left = Counter(t.split())
        left.subtract(w for c in got.get(i, []) for w in c.split())
        assert max(left.values(), default=0) <= 0 or len(t.split()) < len(" ".join(got[i]).split()) + 3, i
