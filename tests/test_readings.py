"""Paths, addresses and readings in JSON at the edges."""

import json

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.operators import readings

BIG = (1 << 60) + 1


def each(spark, texts, f):
    return [r.o for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_files_that_hold_secrets(spark):
    yes = [".env", ".ENV.local", "a/.env.example", "x/id_rsa.pub", "deploy_rsa", "deploy_ed25519.pub", "a/kubeconfig", "Server.PEM", "a.b.kdbx", ".kube/config", "a/.SSH/known", "secrets.yml"]
    no = ["env", ".environment", ".key", "a/.pem", "rsa", "id_rsa.txt", "a/.ssh", "key", "", "src/main.rs", "pem.rs", "a.pub"]
    assert each(spark, yes, P.secret_path) == [True] * len(yes) and each(spark, no, P.secret_path) == [False] * len(no)
    assert each(spark, [None], P.secret_path) == [None]
    assert each(spark, ["a.MIN.js", "b.bundle.js", "c.map", "go.lock", "min.js"], P.generated) == [True, True, True, False, False]
    assert each(spark, ["a/target/b", "target", "a/Target/b", "Pods/x", "a/__pycache__/m.pyc"], P.foreign_path) == [True, False, False, True, True]
    assert each(spark, ["x\n  -----BEGIN OPENSSH PRIVATE KEY-----", "say -----BEGIN PRIVATE KEY-----", "-----BEGIN CERTIFICATE-----", "é" * 1200, None], lambda t: P.content_gate(t, 2000)) == ["secret", None, None, "minified", None]


def test_private_addresses(spark):
    private = ["127.0.0.1", "0.0.0.0", "192.0.2.9", "198.19.0.1", "255.255.255.255", "::1", "::", "fe80::1", "FEBF::", "fd12:3456::1", "fcff::", "ff02::fb", "::ffff:10.1.2.3", "0:0:0:0:0:ffff:7f00:1", "0:0:0:0:0:0:0:1"]
    public = ["0.0.0.1", "8.8.8.8", "198.20.0.1", "2001:db8::1", "fec0::1", "::ffff:8.8.8.8", "::2", "64:ff9b::10.0.0.1", "1:2:3:4:5:6:7:8", "1::", "1:2:3:4:5:6:7::"]
    neither = ["", "1.2.3", "1.2.3.4.", "256.1.1.1", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "::ffff:1.2.3.400", "::1%eth0", "1:2:3:4:5:6:7::8", "fe80::1 ", None]
    assert each(spark, private, P.private_address) == [True] * len(private)
    assert each(spark, public, P.private_address) == [False] * len(public)
    assert each(spark, neither, P.private_address) == [None] * len(neither)


def test_container_totals(spark):
    most = (1 << 63) - 1
    rows = [
        json.dumps({"networks": {"a": {"rx_bytes": most, "tx_bytes": BIG}, "b": {"rx_bytes": 5, "tx_bytes": 1}}, "blkio_stats": {"io_service_bytes_recursive": [{"op": "READ", "value": 3}, {"op": "read", "value": 4}, {"op": "Write", "value": 7}, {"op": "Sync", "value": 99}]}, "pids_stats": {"limit": 18446744073709551615}, "memory_stats": {"limit": 4096}}),
        '{"blkio_stats": {"io_service_bytes_recursive": null}, "pids_stats": {"limit": 0}}', "{}", "no", None,
    ]
    got = readings.container_totals(spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "i int, s string, kept string"), "s").orderBy("i").collect()
    said = [(r.rx, r.tx, r.read, r.written, r.process_limit, r.memory_limit) for r in got]
    assert said == [(most, BIG + 1, 7, 7, None, 4096)] + [(0, 0, 0, 0, None, None)] * 4 and got[0].kept == "x"


def test_segments(spark):
    items = [
        {"text": " a ", "start": 1.5, "end": "2"}, {"text": "b", "start": "00:01:02,5", "end": "1:3"}, {"text": "c", "offsets": {"from": -500, "to": 250}}, {"text": "d", "timestamps": {"from": "00:01", "to": "0:0:2.25"}},
        {"text": "e", "t0": 100, "t1": 50}, {"text": "f", "start": -1, "end": 2, "t0": 300, "t1": 400}, {"text": "g", "start": 1}, {"text": " ", "start": 1, "end": 2}, {"start": 1, "end": 2}, {"text": "h", "start": "1:2:3:4", "end": 9}, {"text": "i", "start": True, "end": "inf"},
    ]
    rows = [(BIG, i, json.dumps(t)) for i, t in enumerate(items)] + [(None, 0, json.dumps(items[0])), (None, 0, json.dumps(items[0])), (3, 0, None), (3, 1, "no")]
    df = spark.createDataFrame(rows, "key long, at long, item string")
    got = {(r.key, r.n, r.start, r.end, r.text) for r in readings.segments(df, "key", ["at"], "item").collect()}
    assert got == {(BIG, 0, 1.5, 2.0, "a"), (BIG, 1, 62.5, 63.0, "b"), (BIG, 2, 0.0, 0.25, "c"), (BIG, 3, 1.0, 2.25, "d"), (BIG, 4, 1.0, 1.0, "e"), (BIG, 5, 3.0, 4.0, "f"), (None, 0, 1.5, 2.0, "a"), (None, 1, 1.5, 2.0, "a")}
    assert readings.segments(df.limit(0), "key", ["at"], "item").count() == 0


def test_stream_timing(spark):
    text = lambda t: json.dumps({"choices": [{"delta": {"content": t}}]})
    usage = lambda p, c: json.dumps({"choices": [], "usage": {"prompt_tokens": p, "completion_tokens": c}})
    rows = [(1, 10, text("")), (1, 20, text("x")), (1, 30, text("y")), (1, 35, usage(9, 1)), (1, 40, usage(None, 2)), (1, 50, " [DONE] "), (2, 5, text(None)), (2, 6, "torn {"), (3, 7, "[DONE]"), (3, 8, None), (None, 1, text("z"))]
    got = {tuple(r) for r in readings.stream_timing(spark.createDataFrame(rows, "run long, at long, p string"), "run", "at", "p").collect()}
    assert got == {(1, 20, 50, 2, 9, 2, "measured"), (2, None, 6, 0, None, None, "no tokens"), (3, None, 8, 0, None, None, "no events"), (None, 1, 1, 1, None, None, "measured")}
