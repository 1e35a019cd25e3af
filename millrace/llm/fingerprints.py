"""I-Match fingerprints: hashes of the terms within a band of inverse document frequency.

Terms are lower-cased words. The lexicon holds the terms that at least one
document in RAREST and at most one in COMMONEST has, or a single document where
there are fewer: as a document has a bounded number of distinct terms on
average, the lexicon has at most that number times RAREST terms, however many
documents there are, so every task can hold it. Frequencies are counted over all
documents.

A fingerprint is a row of hashes, one for each of several random subsets of the
lexicon: the distinct terms of the document within a subset are sorted and
hashed. Subsets hold each term with a probability of 1/8, 1/32, 1/128, 1/512 or
1/2048, so that short and long documents alike have some with few terms, which
survive edits elsewhere in the text. One draw a term divides the lexicon into
disjoint subsets of a size, of which EACH are used. A subset without any term of
the document has the hash 0. A document with words but no lexicon terms has one
hash of all its distinct words in every subset, so it is alike only to those
with the same words.

Likeness of two fingerprints: 1 if they are equal; else, of the subsets that are
not empty in both, the best share of equal hashes over the sizes.

Nulls count as empty; two empty texts are alike (1.0), an empty and another not
(0.0). Repeated rows have equal fingerprints; of rows with equal doc_id those
with the greater text come first. A null doc_id comes last. One document is its
own next. Rows of one doc_id, or without one, pass in order through one task,
which holds two of them at a time. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RAREST, COMMONEST = 2000, 12
RATES, EACH = (3, 5, 7, 9, 11), 32
#: Words that a task remembers at most.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _term(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def lexicon(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST) -> np.ndarray:
    """The sorted hashes of the terms in the band, counted over all rows of docs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        frame = lambda: pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())})
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(set(_WORD.findall((t or "").lower())))
            if len(seen) > 200_000:
                yield frame().assign(term=lambda d: d["term"].map(_term))
                seen.clear()
        if seen:
            yield frame().assign(term=lambda d: d["term"].map(_term))

    rows = docs.count()
    counted = docs.select("text").mapInPandas(count, "term long, n int").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") * rarest >= rows) & ((F.col("n") * commonest <= rows) | (F.col("n") == 1))).select("term")
    return np.sort(band.toPandas()["term"].to_numpy(dtype=np.int64))  # at most rarest times the average number of distinct terms


class Lexicon:
    """The terms of the band and their subsets; a task's copy remembers the places of words among the terms, -1 for words outside."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.subsets, self.known = terms, subsets(terms), {}

    def fingerprint(self, text: str | None) -> np.ndarray:
        """One hash for each subset of the lexicon."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, words = self.known, set(_WORD.findall((text or "").lower()))
        if new := list(words.difference(known)):
            h = np.fromiter(map(_term, new), np.int64, len(new))
            at = np.minimum(np.searchsorted(self.terms, h), max(0, len(self.terms) - 1))
            inside = self.terms[at] == h if len(self.terms) else np.zeros(len(h), bool)
            known.update(zip(new, np.where(inside, at, -1).tolist(), strict=True))
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        found = np.sort(found[found >= 0])
        if words and not len(found):
            return np.full(len(RATES) * EACH, xxhash.xxh64_intdigest("\n".join(sorted(words))) | 1, np.uint64)
        return hashed(self.terms[found], self.subsets[:, found])


def subsets(terms: np.ndarray) -> np.ndarray:
    """A row for each draw: the number of the subset that each term falls in, -1 for none."""
    h, rows = terms.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for level, rate in enumerate(RATES):
            for first in range(0, EACH, 1 << rate):
                cell = (_mix(h + np.uint64(1 + (rate << 8 | first)) * _M) >> np.uint64(64 - rate)).astype(np.int16) + np.int16(first)
                rows.append(np.where(cell < EACH, cell + np.int16(level * EACH), np.int16(-1)))
    return np.array(rows)


def hashed(terms: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One hash for each subset, from the sorted hashes of a text's terms in the band and their columns of subsets()."""
    out = [0] * (len(RATES) * EACH)
    draw, term = np.nonzero(of >= 0)
    cell = of[draw, term]
    order = np.argsort(cell, kind="stable")  # terms stay sorted within a subset
    ends = np.cumsum(np.bincount(cell, minlength=len(out))) * 8
    raw, at = terms[term[order]].tobytes(), 0
    for k, end in enumerate(ends.tolist()):
        if end > at:
            out[k] = xxhash.xxh64_intdigest(raw[at:end], RATES[k // EACH]) | 1
            at = end
    return np.array(out, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The best share of equal hashes over the sizes of subsets."""
    same = a == b
    if same.all():
        return 1.0
    some = (a != 0) | (b != 0)
    alike, either = (same & some).reshape(len(RATES), -1).sum(1), some.reshape(len(RATES), -1).sum(1)
    return max((float(n / of) for n, of in zip(alike, either, strict=True) if of * 8 >= EACH), default=0.0)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text, ahead), to be read in order: each part is a range of ids, highest first, and the rows of the highest id below it follow as `ahead`.

    Ranges come from quantiles of doc_id; only their bounds and highest ids, a few numbers a part, reach the driver.
    """
    ids = docs.select(F.col("doc_id").cast("long"))
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = F.lit(0)
    if cuts:  # the number of cuts that are not over the id; the highest ids are part 0
        bounds = F.array(*[F.lit(int(c)) for c in cuts])
        part = F.lit(len(cuts)) - F.aggregate(bounds, F.lit(0), lambda n, c: n + (F.col("doc_id") >= c).cast("int"))
    part = F.coalesce(part, F.lit(len(cuts) + 1)).cast("int")
    top = {r["part"]: r["top"] for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(top)
    # after the last part comes the first again
    lead = [(order[i - 1], top[p]) for i, p in enumerate(order)]
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("own", part)
    # the highest id of each part is read by the part before it too: a row a part, so it may be broadcast
    spark = docs.sparkSession
    goes = F.broadcast(spark.createDataFrame([(p, t, q) for q, t in lead for p in order if p == order[(order.index(q) + 1) % len(order)]], "of int, top long, other int"))
    ahead = numbered.join(goes, (F.col("own") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))).select(F.col("other").alias("part"), "doc_id", "text", F.lit(1).alias("ahead"))
    return numbered.select(F.col("own").alias("part"), "doc_id", "text", F.lit(0).alias("ahead")).union(ahead)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, its edited text, both fingerprints (binary) and near_edited, near_next."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    parts = max(1, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Lexicon(held.value)
        last = None  # (part, doc_id, text, fingerprint) of the row that waits for its next

        def closed(text: str, mine: np.ndarray, following: str, its: np.ndarray) -> tuple:
            e = edited(text, following)
            f = words.fingerprint(e)
            return len(text), e, mine.tobytes(), f.tobytes(), likeness(mine, f), likeness(mine, its)

        out: list[tuple] = []
        for pdf in batches:
            for p, i, t, ahead in zip(pdf["part"], pdf["doc_id"], pdf["text"], pdf["ahead"], strict=True):
                if ahead and (last is None or last[0] != p):
                    continue
                t = t or ""
                mine = words.fingerprint(t)
                if last is not None and last[0] == p:
                    out.append((last[1], *closed(last[2], last[3], t, mine)))
                last = None if ahead else (p, None if i is None else int(i), t, mine)
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object).astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})
            out = []

    dealt = with_next(docs, parts).repartitionByRange(parts, "part").sortWithinPartitions("part", "ahead", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # beside a null, Python would make a number a double
    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


COLUMNS = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprints(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.hex("fingerprint").alias("fingerprint"), F.hex("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
