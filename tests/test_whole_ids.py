"""Keys and ids above 2^53 stay whole beside nulls in what carries a state from row to row."""

from datetime import datetime, timedelta

from millrace.operators import layout
from millrace.streaming import throttle

A = (1 << 60) + 1


def test_carried_keys(spark):
    rows = spark.createDataFrame([(A, 1.0), (A, 1.2), (A + 1, 5.0), (None, 1.0), (None, 9.0)], "k long, v double").coalesce(1)
    got = sorted(((r["k"], r["v"], r["cluster"]) for r in layout.anchored(rows, "k", "v", 0.5).collect()), key=str)
    assert got == sorted([(A, 1.0, 0), (A, 1.2, 0), (A + 1, 5.0, 0), (None, 1.0, 0), (None, 9.0, 1)], key=str)


def test_throttled_ids(spark):
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame([(A, A, t), (A, A + 1, t + timedelta(seconds=9)), (A + 1, None, t), (None, 4, t), (A + 1, 5, None)], "user_id long, event_id long, ts timestamp_ntz").coalesce(1)
    got = {(r["user_id"], r["event_id"], r["suppressed"]) for r in throttle.throttled(events, 5000).collect()}
    assert got == {(A, A, 0), (A, A + 1, 0), (A + 1, None, 0)}
