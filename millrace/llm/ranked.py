"""Ranked lexical search by TPUT over term-partitioned postings.

Terms are runs of letters, digits and characters beyond ASCII, only A-Z
lower-cased. A posting holds a term's impact in a document, (10^9 tf) div
(1000 tf + 12 m); an item's score of a document is the sum of its terms' weights
times impacts, all in 64-bit integers. Postings of the items' terms are a table
in order of term and falling impact, so a frequent term's list is cut into as
many partitions as its length takes and its head lies together.

1. The K first of every list: the K documents for which they give an item the
   largest sums are looked up in all its lists, and the least of these scores is a
   lower bound of its K-th score.
2. Every list of an item is read down to the same value, that bound divided by
   the number of its lists: a document in none of what is read has less than the
   bound. The sums give a better bound, and with the most that unread entries can
   add an upper one for each document; those below the bound go.
3. The exact scores of the candidates left are looked up in all lists.

The items' terms are sent to tasks up to VOCABULARY of them, and so are thresholds
and candidates up to BROADCAST rows, which are counted first; beyond, they are
joined by a shuffle. No list, and no item's candidates, pass through one task or
the driver; heads and ranks are cut to K rows a task before they meet.

Nulls and texts without a term are no documents and match nothing. Rows without a
doc_id count in the statistics but are not returned. Rows that repeat a doc_id are
documents of their own, and so are items that repeat an item_id; equal scores of
equal ids are ranked by row. A term in every document has the weight 0 and no
list. Long texts are read whole. Extra columns are allowed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 20
#: Terms sent to every task, and rows of thresholds or candidates sent to every task.
VOCABULARY, BROADCAST = 1_000_000, 500_000

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text with repeats, in UTF-8; no byte of a longer character is a separator."""
    return (text or "").encode("utf-8", "replace").translate(_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q) of the terms of each row of items, q their repeats."""

    @F.pandas_udf("array<struct<term:string,q:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[(t.decode(), q) for t, q in Counter(terms(x)).items()] for x in texts])

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return rows.select("item", "item_id", F.explode(run("text")).alias("t")).select("item", "item_id", "t.*")


def term_lists(docs: DataFrame, words: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """(row, doc_id, n, found) of each document: its number of terms, and (term, tf) of those in words (term, word)."""
    spark = docs.sparkSession
    small = words.limit(most + 1).count() <= most
    known = spark.sparkContext.broadcast({r["word"].encode(): r["term"] for r in words.toLocalIterator()} if small else None)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        get = known.value
        for texts in batches:
            ns, found, tfs = [], [], []
            for x in texts:
                every = terms(x)
                ns.append(len(every))
                counts = Counter(every)
                shared = counts if get is None else counts.keys() & get.keys()
                found.append([t.decode() for t in shared] if get is None else np.array([get[t] for t in shared], np.int64))
                tfs.append(np.array([counts[t] for t in shared], np.int64))
            yield pd.DataFrame({"n": ns, "term": found, "tf": tfs})

    count = F.pandas_udf(run, f"struct<n:long,term:array<{'long' if small else 'string'}>,tf:array<long>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), count("text").alias("c")).select("row", "doc_id", "c.*")
    return rows.where("n > 0").select("row", "doc_id", "n", F.arrays_zip("term", "tf").alias("found"))


def _sent(df: DataFrame, scratch: Scratch, what: str) -> tuple[DataFrame, DataFrame]:
    """df as a table, and the same marked for broadcast if it is within BROADCAST rows."""
    df = scratch.written(df, what)
    return df, F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def postings(lists: DataFrame, words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The postings (term, row, doc_id, impact) in order of term and falling impact, and (term, w), both without terms of weight 0."""
    sums = lists.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    docs, total = sums["n"], sums["l"] or 0
    each = lists.select("row", "doc_id", "n", F.explode("found").alias("t")).select("row", "doc_id", "n", "t.*")
    if dict(each.dtypes)["term"] == "string":
        each = each.withColumnRenamed("term", "word").join(words, "word").drop("word")
    weight = F.floor(1000 * F.log((2.0 * F.lit(docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = scratch.written(each.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0"), "weights")
    m = f"(75 + (25 * n * {docs}L) div {max(total, 1)}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000 * tf + 12 * {m})").alias("impact")
    rows = each.where("doc_id is not null").join(weights.select("term"), "term", "left_semi").select("term", "row", "doc_id", impact)
    return scratch.written(rows.repartitionByRange("term", F.desc("impact"), "row").sortWithinPartitions("term", F.desc("impact")), "postings"), weights


def _first(rows: DataFrame, by: str, *order, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _bounds(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound): the k-th largest sum, if there are as many."""
    return _first(sums, "item", F.desc("score"), "row", k=k).where(F.col("rank") == k).select("item", F.col("score").alias("bound"))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties by doc_id."""
    scratch = Scratch(docs.sparkSession)
    asked = scratch.written(item_terms(items), "items")
    words = scratch.written(asked.select(F.col("term").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")), "words")
    lists = scratch.written(term_lists(docs, words, vocabulary), "lists")
    posted, weights = postings(lists, words, scratch)
    scratch.clear("lists")
    # an item's lists: qw is what an impact of 1 adds
    owed = asked.withColumnRenamed("term", "word").join(words, "word").join(weights, "term").select("item", "item_id", "term", (F.col("q") * F.col("w")).alias("qw"))
    owed, sent = _sent(owed, scratch, "owed")

    def exact(pairs: DataFrame, sent_pairs: DataFrame) -> DataFrame:
        """(item, item_id, row, doc_id, score) of pairs (item, row), looked up in all lists."""
        lookups = sent_pairs.join(owed, "item").select("item", "row", "term", "qw", "item_id")
        kept = posted.join(F.broadcast(pairs.select("row").distinct()), "row", "left_semi") if pairs is not sent_pairs else posted
        return kept.join(lookups, ["term", "row"]).groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("impact") * F.col("qw")).alias("score"))

    heads = scratch.written(_first(posted, "term", F.desc("impact"), "row", k=k), "heads")
    lower = heads.join(sent, "term").groupBy("item", "row").agg(F.sum(F.col("impact") * F.col("qw")).alias("score"))
    bound = _bounds(exact(*_sent(_first(lower, "item", F.desc("score"), "row", k=k).select("item", "row"), scratch, "first")), k)
    many = owed.groupBy("item").agg(F.count("*").alias("lists")).join(bound, "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    need = F.expr("(bound + lists * qw - 1) div (lists * qw)").alias("need")  # the least impact that is read
    limits = owed.join(many, "item").join(heads.groupBy("term").agg(F.max("impact").alias("high")), "term").select("item", "term", "qw", "bound", "high", need)
    unread = F.least(F.greatest(F.col("need") - 1, F.lit(0)), "high") * F.col("qw")  # the most that an entry which isn't read adds
    limits, sent_limits = _sent(limits.select("item", "term", "qw", "bound", "need", unread.alias("unread")), scratch, "limits")
    small = limits is not sent_limits
    least = limits.groupBy("term").agg(F.min("need").alias("least"))

    entries = posted.join(F.broadcast(least) if small else least, "term").where("impact >= least").drop("doc_id", "least")
    entries = entries.repartition("row") if small else entries  # an entry travels once for all items, and sums need no other shuffle
    read = entries.join(sent_limits, "term").where("impact >= need")
    seen = read.groupBy("item", "row").agg(F.sum(F.col("impact") * F.col("qw")).alias("score"), F.sum("unread").alias("known"))
    most = limits.groupBy("item").agg(F.sum("unread").alias("most"), F.max("bound").alias("bound"))
    upper = F.col("score") + F.col("most") - F.col("known")
    seen = scratch.written(seen.join(F.broadcast(most) if small else most, "item").where(upper >= F.col("bound")).select("item", "row", "score", upper.alias("upper")), "seen")
    hopeful = seen.join(_bounds(seen, k), "item", "left").where("upper >= coalesce(bound, 0)").select("item", "row")
    scores = exact(*_sent(hopeful, scratch, "candidates")).where("score > 0")
    best = _first(scores, "item", F.desc("score"), "doc_id", "row", k=k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = scratch.written(best, "ranks", lasting=True)
    scratch.clear()
    return out


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
