"""Seeded numbers, zones, and states carried along: cases at the edges."""

import random

from pyspark.sql import functions as F

from millrace.functions import seeded, zones
from millrace.operators import upkeep


def _mixed(x):
    m = (1 << 64) - 1
    x = (x + seeded.STEP) & m
    x = ((x ^ x >> 30) * seeded.FIRST) & m
    x = ((x ^ x >> 27) * seeded.SECOND) & m
    return x ^ x >> 31


def test_mix_wraps_around(spark):
    rng = random.Random(3)
    ids = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(200))]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", seeded.mix64(F.col("i")).alias("m")).collect()
    assert all(r["m"] % 2**64 == _mixed(r["i"] % 2**64) for r in got)
    assert next(r["m"] for r in got if r["i"] == 0) % 2**64 == 0xE220A8397B1DCDAF  # the first value of SplitMix64 from 0


def test_waits_stay_in_their_band(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("n"), seeded.jittered_wait(F.col("id") % 20, F.col("id") * 7919 - 900000, 1000, 30_000).alias("w")).collect()
    for r in rows:
        top = min(1000 * 2 ** min(max(r["n"] - 1, 0), 16), 30_000)
        assert top // 2 <= r["w"] <= top
    assert len({r["w"] for r in rows}) > 100


def test_clock_changes(spark):
    local = ["2024-03-31 01:59:00", "2024-03-31 02:30:00", "2024-03-31 03:00:00", "2024-10-27 02:30:00", None]
    rows = spark.createDataFrame([(t,) for t in local], "t string").select(zones.moment_of(F.col("t").cast("timestamp_ntz"), "Europe/Berlin").cast("string").alias("m")).collect()
    assert [r["m"] for r in rows] == ["2024-03-31 00:59:00", None, "2024-03-31 01:00:00", "2024-10-27 00:30:00", None]


def test_grants_keep_remainders(spark):
    asks = [(1, 0, 0, 80), (1, 0, 1, 80), (1, 59, 2, 5), (1, 60, 3, 5), (1, 60_060, 4, 500), (2, 5, 5, 0)]
    got = upkeep.byte_grants(spark.createDataFrame(asks, "k long, now long, e long, want long"), "k", "now", "e", "want", 100, 1000)
    assert {r["e"]: (r["granted"], r["left"]) for r in got.collect()} == {0: (80, 20), 1: (20, 0), 2: (0, 0), 3: (1, 0), 4: (100, 0), 5: (0, 100)}


def test_files_roll(spark):
    writes = spark.createDataFrame([(1, 0, 150), (1, 1, 10), (1, 2, 90), (1, 3, 1), (2, 4, 5)], "f long, n long, bytes long")
    got = {r["n"]: (r["rotated"], r["generation"]) for r in upkeep.rolled(writes, "f", ["n"], 100).collect()}
    assert got == {0: (False, 0), 1: (True, 1), 2: (False, 1), 3: (True, 2), 4: (False, 0)}


def test_serving_sets(spark):
    seen = [(0, 0, 7, "a,b", False), (0, 1, 8, "a", False), (0, 2, 7, "b,c", False), (0, 3, 8, "z", False), (0, 4, 7, "", True), (0, 5, 8, "x", False), (0, 6, 8, "x,y", False), (0, 7, 7, "q", True)]
    frame = spark.createDataFrame(seen, "t long, n long, peer long, models string, down boolean")
    said = lambda capacity: {r["n"]: (r["added"], r["removed"]) for r in upkeep.tracked(frame, "t", ["n"], capacity).collect()}
    full = said(1)
    assert full[2] == ("c", "a") and full[3] == ("", "") and full[4] == ("", "b,c") and full[5] == ("", "") and full[6] == ("y", "") and full[7] == ("", "")
    free = upkeep.transitions(frame.withColumn("models", F.filter(F.split("models", ","), lambda m: m != "")), "peer", ["n"], "models", F.col("down"))
    assert said(9) == {r["n"]: (",".join(r["added"]), ",".join(r["removed"])) for r in free.collect()} and said(9)[3] == ("z", "a")


def test_logs_with_little_to_drop_stay(spark):
    log = spark.range(600).select((F.col("id") % 2).alias("c"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).otherwise(F.col("id")).alias("k"), "id", F.lit(False).alias("gone"))
    got = {r["c"]: r for r in upkeep.compaction(log, "c", "k", ["id"], F.col("gone"), least_lines=301).collect()}
    assert got[0].asDict() == {"c": 0, "log_lines": 301, "dead_lines": 275, "compacts": True, "lines_after": 26} and not got[1]["compacts"] and got[1]["lines_after"] == 301
    assert not any(r["compacts"] for r in upkeep.compaction(log, "c", "k", ["id"], F.col("gone")).collect())


def test_groups_of_rows(spark):
    lines = [(1, 100.0, 0, 10.0, 2), (1, 88.0, 1, 10.0, 3), (1, 60.0, 2, 10.0, 2), (1, 50.0, 3, 10.0, 1), (1, 40.0, 4, 10.0, 2), (1, 30.0, 5, 10.0, 2), (2, 5.0, 6, 1.0, 4)]
    got = upkeep.row_groups(spark.createDataFrame(lines, "p long, y double, n long, h double, c int"), "p", "y", ["n"], "h", "c")
    assert sorted(map(tuple, got.collect())) == [(1, 40.0, 30.0, 2), (1, 100.0, 88.0, 2)]
