"""Ids above 2^53 stay whole beside nulls."""

from millrace.llm import fingerprints, neardup, warc
from millrace.llm.common import fresh_path

A = (1 << 60) + 1


def test_warc_ids(spark):
    same = "x" * 2000
    pages = spark.createDataFrame([(A, "u", same), (A + 1, "u", same), (A + 2, "u", "small"), (None, "u", same), (None, "u", "y" * 1500)], "page_id long, url string, html string")
    folder = fresh_path(spark, "ids")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, folder, warc.write(pages.coalesce(1), folder)).collect()}
    assert got == {(A, "revisit", A + 1), (A + 1, "response", None), (A + 2, "response", None), (None, "revisit", A + 1), (None, "response", None)}


def test_fingerprint_ids(spark):
    docs = spark.createDataFrame([(A + i, f"some words {i} of text") for i in range(5)] + [(None, "no id")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in fingerprints.fingerprints(docs).select("doc_id").collect()} == {*range(A, A + 5), None}


def test_neardup_ids(spark):
    docs = spark.createDataFrame([(A + i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(3)] + [(None, "no id at all here")], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["component_id"]) for r in neardup.classes(docs).collect()} == {(A, A), (A + 1, A + 1), (A + 2, A + 2), (None, None)}
