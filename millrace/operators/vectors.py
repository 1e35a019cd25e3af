"""Exact vector search with metadata filters, and the lookup of a semantic cache."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, about; rows of a bucket from which it is dealt to more than one; pairs that are scored at a time.
BLOCK, FEW, MET = 16_384, 256, 1 << 21


def dot(a: Column, b: Column) -> Column:
    """Summed from left to right in double precision; null if widths differ, a vector is empty or a component is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; null for vectors that are zero, not finite, or not of one width."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def normalized(a: Column) -> Column:
    """The vector at length one; null for one that is empty, zero or not finite."""
    length = norm(a)
    return F.when((length > 0) & (length < float("inf")), F.transform(a, lambda x: x.cast("double") / length))


def matches(metadata: dict[Column, object] | None = None, source: Column | None = None, source_prefix: str | None = None, document: Column | None = None, documents: Iterable | None = None) -> Column:
    """A conjunction of metadata equality, a prefix of the source and a set of documents; a missing value excludes."""
    parts = [c == v for c, v in (metadata or {}).items()]
    parts += [F.startswith(source, F.lit(source_prefix))] if source_prefix else []
    parts += [document.isin(*documents)] if documents is not None else []
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The k most similar rows, ties by id; Spark keeps k rows a task, so nothing is sorted as a whole."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*map(F.lit, map(float, query)))
    scored = rows.select("vec_id", "label", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null")
    return (scored if min_score is None else scored.where(F.col("score") >= min_score)).orderBy(F.desc("score"), "vec_id").limit(k)


def _scores(q: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the rows q[i] and e[j], with the very sums of cosine(); NaN where it is null."""

    def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast(i, j).shape)
        for c in range(a.shape[1]):
            total += a[i, c] * b[j, c]
        return total

    with np.errstate(all="ignore"):
        n, m = (np.sqrt(dots(x, x, k, k)) for x, k in ((q, i), (e, j)))
        return np.clip(dots(q, e, i, j) / (n * m), -1.0, 1.0)


def _best_of_block(asked: pa.Table, held: pa.Table, names: list[str]) -> pa.Table:
    """Each lookup's entries of a block that can be best after rounding: of equal scores the smallest id. Products of matrices find them, _scores() scores them."""
    held = held.sort_by([("entry_id", "ascending"), *[(c, "descending") for c in names if c == "entry_size"]])
    flat = ((np.array(t[c].combine_chunks().flatten(), "float64"), t.num_rows) for t, c in ((held, "embedding"), (asked, "q")))
    e, q = (x.reshape(n, len(x) // max(1, n)) for x, n in flat)
    ids, said = (np.array(t[c]) for t, c in ((held, "entry_id"), (asked, "query_id")))
    first, past = np.searchsorted(ids, said, "left"), np.searchsorted(ids, said, "right")
    of, got, scores = [np.empty(0, "int64")], [np.empty(0, "int64")], [np.empty(0)]
    if len(e) and len(q):
        long_q, long_e = (np.linalg.norm(x, axis=1) for x in (q, e))
        plain = all(x.min() > 1e-100 and x.max() < 1e100 for x in (long_q, long_e))  # else squares may leave the range of doubles, which _scores() alone treats as cosine() does
        unit = (e / long_e[:, None]).T if plain else None
        step = max(1, MET // len(e))
        for at in range(0, len(q), step):
            rows = np.arange(at, min(at + step, len(q)))
            near = (q[rows] / long_q[rows, None]) @ unit if plain else _scores(q, e, rows[:, None], np.arange(len(e))[None])
            for k in np.flatnonzero(past[rows] > first[rows]):
                near[k, first[rows[k]] : past[rows[k]]] = np.nan
            near[np.isnan(near)] = -np.inf
            i, j = np.nonzero((near >= near.max(axis=1, keepdims=True) - 1.01e-6) & (near > -np.inf))
            i = rows[i]
            exact = _scores(q, e, i, j)
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
            of.append(i[new]), got.append(j[new]), scores.append(exact[new])
    of, got = pa.array(np.concatenate(of)), pa.array(np.concatenate(got))
    sides = {"score": pa.array(np.concatenate(scores)), **{c: t[c].take(k) for c in names for t, k in ((asked, of), (held, got)) if c in t.column_names}}
    return pa.table({c: sides[c] for c in names})


def nearest(lookups: DataFrame, entries: DataFrame, bucket: str, threshold: float, ratio: float | None = None, blocks: int = 32) -> DataFrame:
    """(query_id, entry_id, score, hit): each lookup's best entry of its bucket but itself, or a miss.

    The best that fails the threshold, or whose size (if ratio is given) differs
    by more than that factor, is a miss, never the second best. Every lookup
    meets every entry of its bucket, in products of matrices. Entries and
    lookups are dealt to blocks of bounded size within their bucket, at least
    `blocks` of a large one, and each pair of blocks gives the best of its
    lookups, so a hot bucket spreads over tasks.
    """
    extra = ["size"] if ratio else []
    sound = F.col("vec_id").isNotNull() & F.col(bucket).isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(F.col("embedding")) > 0)
    e = entries.where(sound).select(F.col("vec_id").alias("entry_id"), bucket, F.size("embedding").alias("width"), "embedding", *[F.col(c).alias("entry_size") for c in extra])
    l = lookups.where(sound).select(F.col("vec_id").alias("query_id"), bucket, F.size("embedding").alias("width"), F.col("embedding").alias("q"), *[F.col(c).alias("query_size") for c in extra])
    most_e, most_l = (d.groupBy(bucket).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] for d in (e, l))
    dealt = {"block": max(min(blocks, -(-most_e // FEW)), -(-most_e // BLOCK), 1), "part": max(1, -(-most_l // BLOCK))}

    def own(key: str, name: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(dealt[name])).cast("int").alias(name)

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(dealt[name] - 1))).alias(name)

    by = [bucket, "width", "block", "part"]
    asked, held = l.select("*", own("query_id", "part"), every("block")), e.select("*", own("entry_id", "block"), every("part"))
    columns = ["query_id", "entry_id", "score", *(["query_size", "entry_size"] if ratio else [])]
    kinds = {"score": "double", **dict(l.dtypes), **dict(e.dtypes)}
    scored = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(lambda a, b: _best_of_block(a, b, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))
    scored = scored.withColumn("score", F.round("score", 6))
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("entry_id")).alias("first"), *[F.col(c) for c in (["query_size", "entry_size"] if ratio else [])])).alias("b"))
    hit = F.col("b.score") >= threshold
    if ratio:
        a, b = F.col("b.query_size"), F.col("b.entry_size")
        hit = hit & F.when((a == 0) | (b == 0), a == b).otherwise(F.greatest(a, b) <= ratio * F.least(a, b))
    return best.select("query_id", (-F.col("b.first")).alias("entry_id"), F.col("b.score").alias("score"), hit.alias("hit"))
