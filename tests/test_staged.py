"""Stores of lines: whole versions, tokens, torn manifests, compaction in place, files that roll."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import upkeep
from millrace.sources import oplog, staged

HEAD = '{"op":"header","model":"m","width":1}'


def lines(spark, name, start, raws):
    return spark.createDataFrame([(name, start + i, r) for i, r in enumerate(raws)], "collection string, line long, raw string")


def put(i):
    return f'{{"op":"put","id":"{i}","document":"d","model":"m","vector":[1.0]}}'


def test_logs_are_compacted_in_place(spark, tmp_path):
    store = staged.log_store(spark, f"file://{tmp_path}/logs", 4)
    assert store.rows().count() == 0 and staged.compact(store, "none").count() == 0
    assert store.put(lines(spark, "busy", 0, [HEAD, *[put(i % 3) for i in range(30)]]), "a")
    assert store.put(lines(spark, "calm", 0, [HEAD, put(1), put(2)]), "b")
    assert store.put(lines(spark, "bad", 0, [HEAD, "?", put(1)]), "c")
    assert store.put(lines(spark, None, 0, ["kept"]), "d")
    assert not store.put(lines(spark, "busy", 99, [put(9)]), "a")  # done before
    said = {r["collection"]: (r["lines"], r["compacts"], r["lines_after"]) for r in staged.compact(store, "e", 20).collect()}
    assert said == {"busy": (31, True, 4), "calm": (3, False, 3), "bad": (3, False, 3)}
    held = {r["collection"]: r["n"] for r in store.rows().groupBy("collection").agg(F.count("*").alias("n")).collect()}
    assert held == {"busy": 4, "calm": 3, "bad": 3, None: 1}
    version = store.manifest()["version"]
    staged.compact(store, "e", 1)
    staged.compact(store, "f", 20)  # nothing is due any more
    assert store.manifest()["version"] == version
    assert store.clear() >= 1 and store.rows().count() == 11
    chunks = {(r["collection"], r["id"]) for r in oplog.state(store.rows())[0].collect()}
    assert chunks == {("busy", "0"), ("busy", "1"), ("busy", "2"), ("calm", "1"), ("calm", "2")}


def test_versions_are_whole_and_stale_writers_refused(spark, tmp_path):
    store = staged.log_store(spark, f"file://{tmp_path}/logs", 4)
    store.put(lines(spark, "x", 0, [HEAD]), "a")
    old = store.manifest()
    store.put(lines(spark, "x", 1, [put(1)]), "b")
    with pytest.raises(RuntimeError, match="no longer"):
        store.put(lines(spark, "x", 1, [put(2)]), "c", manifest=old)
    assert store.rows().count() == 2
    (tmp_path / "logs" / "manifests" / "3").write_text('{"version": 3, "fol')  # its writer was lost
    assert store.manifest()["version"] == 2 and store.rows().count() == 2
    store.put(lines(spark, "x", 2, [put(2)]), "d")
    assert store.manifest()["version"] == 4 and store.rows().count() == 3


def test_parts_in_many_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staged, "PIECES", 2)
    store = staged.log_store(spark, f"file://{tmp_path}/logs", 2)
    for n in range(4):
        store.put(lines(spark, "x", n, [put(n) if n else HEAD]), f"t{n}")
    staged.compact(store, "m")
    assert [len(f) for f in store.manifest()["folders"].values()] == [1]
    assert sorted(r["line"] for r in store.rows().collect()) == [0, 1, 2, 3]


def by_rule(batches, most):
    now, before = {}, {}
    for batch in batches:
        for f, _, r in sorted(batch, key=lambda x: (x[1], x[2] or "")):
            size = sum(len(x.encode()) + 1 for x in now.get(f, []))
            if size and size + len((r or "").encode()) + 1 > most:
                before[f], now[f] = now[f], []
            now.setdefault(f, []).append(r or "")
    return {**{(f, 0): v for f, v in now.items()}, **{(f, 1): v for f, v in before.items()}}


def test_files_roll_in_place(spark, tmp_path):
    store = staged.file_store(spark, f"file://{tmp_path}/files", 4)
    first = [("a", n, "x" * (n % 7)) for n in range(20)] + [("b", 1, "long" * 30), ("b", 2, None), ("é", (1 << 60) + 1, "é"), ("é", (1 << 60) + 1, "é")]
    second = [("a", 5, "later"), ("b", 0, "long" * 30), ("new", 3, "")]
    schema = "file string, number long, record string"
    for token, batch in (("1", first), ("2", second)):
        assert staged.append_records(store, spark.createDataFrame(batch, schema), token, 30)
    assert not staged.append_records(store, spark.createDataFrame(second, schema), "2", 30)
    got = {}
    for r in store.rows().orderBy("number").collect():
        got.setdefault((r["file"], r["generation"]), []).append(r["record"])
    assert got == by_rule([first, second], 30)
    staged.write_files(store, f"{tmp_path}/out")
    texts = [p.read_text() for p in (tmp_path / "out" / "file=a" / "generation=0").glob("part-*")]
    assert texts == ["".join(x + "\n" for x in got["a", 0])]
    with pytest.raises(ValueError, match="no file"):
        staged.append_records(store, spark.createDataFrame([(None, 1, "x")], schema), "3", 30)
    assert staged.append_records(store, spark.createDataFrame([], schema), "4", 30) and store.rows().count() == sum(map(len, got.values()))


def test_rolls_see_what_a_file_held_in_another_part_of_a_union(spark):
    """Few summed rows beside many numbered ones: each side is shuffled by file, and the few are merged to fewer partitions."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        held = spark.range(60).selectExpr("concat('f', id) as file", "0L as number", "90L as bytes")
        held = held.groupBy("file").agg(F.max("number").alias("number"), F.sum("bytes").alias("bytes"))
        new = spark.range(12_000).selectExpr("concat('f', id % 60) as file", "id", "repeat('x', 40) as said")
        new = new.withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("id", "said")).cast("long")).select("file", "number", (F.length("said") - 30).cast("long").alias("bytes"))
        got = upkeep.rolled(held.unionByName(new), "file", ["number"], 100).groupBy("file").agg(F.max("generation").alias("last"), F.min(F.when(F.col("rotated"), F.col("number"))).alias("first"))
        assert {tuple(r) for r in got.collect()} == {(f"f{i}", 20, 2) for i in range(60)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_task_sorts_all_lines_of_a_log(spark):
    """A grouping that keeps texts or structs sorts the lines of a task, a join by collection those of a log, so their memory grows with them."""
    chunks, logs = oplog.state(lines(spark, "a", 0, [HEAD, put(1)]))
    for rows in (chunks, logs):
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "max_by(" not in plan and not re.search(r"SortMergeJoin \[collection#\d+\], \[collection#\d+\], (Inner|LeftSemi)", plan)


def test_a_put_whose_number_is_repeated_counts_once(spark):
    log = lines(spark, "a", 0, [HEAD, put(1), put(2)]).unionByName(lines(spark, "a", 1, [put(1)]))
    chunks, logs = oplog.state(log)
    assert sorted(r["id"] for r in chunks.collect()) == ["1", "2"] and logs.first()["chunks"] == 2
