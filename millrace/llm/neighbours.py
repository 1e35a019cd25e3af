"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first.

Vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, and
queries 0, so that the largest inner product is the least distance. The tree is
fitted on a bounded sample; every row is then put into its leaf. A query walks
the tree by a priority queue of nodes in the order of distance to their centres
and visits leaves in that order. How many it visits is widened until, for a
sample of queries whose exact neighbours over all rows are known, the recall
reaches RECALL.

Leaves are cut into pieces of rows and of queries, so that a leaf full of
copies spreads over many tasks. Each piece gives each query's best; a window by
query takes the best of those. Scores are inner products of the original
vectors in double precision, summed alike for equal vectors, so copies tie and
the smaller vec_id comes first.

Vectors that are null, zero, of another width than most, or hold null or
non-finite components take no part. A null vec_id takes no part. Repeated rows are
candidates each; of rows with the id of a query one is the query. With few rows
every leaf is visited as far as K neighbours need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, EVERY, RECALL = 20, 20, 0.97
#: Bounds of the samples that fit the tree and calibrate it, and the tree's branches and leaf rows (of the sample).
SAMPLE, QUERIES, BRANCHES, LEAF = 20_000, 128, 8, 100
ROWS, ASKED = 4096, 4096


class Tree:
    """Centres of nodes, children of inner nodes, and the leaves' numbers."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.centres, self.children, self.leaf = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(x, x.mean(0) if len(x) else np.zeros(x.shape[1]), rng, 0)
        self.centres = np.array(self.centres)

    def _grow(self, x: np.ndarray, centre: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        me = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        distinct = np.unique(x, axis=0) if len(x) > LEAF else x[:0]
        if len(distinct) < 2 * BRANCHES or depth > 8:
            self.leaf[me], self.leaves = self.leaves, self.leaves + 1
            return me
        c = distinct[rng.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(12):
            at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(BRANCHES)])
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        for k in range(BRANCHES):
            if (at == k).any():
                self.children[me].append(self._grow(x[at == k], c[k], rng, depth + 1))
        return me

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child each time."""
        out, stack = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            at = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            stack += [(child, rows[at == k]) for k, child in enumerate(self.children[node]) if (at == k).any()]
        return out

    def visits(self, q: np.ndarray, sizes: np.ndarray, least: int, rows: int) -> list[int]:
        """Leaves in best-bin-first order: `least` of them, and on until they hold `rows` rows."""
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < least or seen < rows):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                seen += int(sizes[self.leaf[node]])
            for child, d in zip(self.children[node], ((self.centres[self.children[node]] - q) ** 2).sum(1) if self.children[node] else (), strict=True):
                heapq.heappush(queue, (float(d), child))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return rows.where(F.size("v") == (widths[0]["width"] if widths else 0))


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, scores) of each query's k best rows, some queries at a time; ties to the smaller id.

    Every score is summed in the same order, so equal vectors have equal scores.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    step = max(1, 1_000_000 // x.size)
    for at in range(0, len(q), step):
        score = (x[None, :, :] * q[at : at + step, None, :]).sum(2)
        mine = own[at : at + step, None]
        score[ids[None, :] == mine] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(score, top, 1)
        fine = best > -np.inf
        yield np.broadcast_to(mine, top.shape)[fine], ids[top][fine], best[fine]


def search(vectors: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    stats = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    norm = float(stats["norm"])
    longer = lambda x: np.hstack([x, np.sqrt(np.maximum(0, norm - (x**2).sum(1)))[:, None]])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    tree = Tree(longer(np.array(sample.tolist(), dtype=float)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=float)
            if len(x):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "leaf": tree.place(longer(x)), "v": [r.astype("<f8").tobytes() for r in x]})

    placed = written(rows.mapInPandas(place, "vec_id long, leaf int, v binary"), "placed")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r["leaf"]] = r["count"]
    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v")
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(QUERIES).toPandas()
    if not len(asked):
        return spark.createDataFrame([], schema)
    q, q_ids = _matrix(asked["v"].tolist()), asked["query_id"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, ids, leaf = _matrix(pdf["v"].tolist()), pdf["vec_id"].to_numpy(), pdf["leaf"].to_numpy()
                for own, v in zip(q_ids, q, strict=True):
                    s = np.where(ids == own, -np.inf, x @ v)
                    top = np.argpartition(-s, min(k, len(s) - 1))[:k]
                    yield pd.DataFrame({"query_id": own, "leaf": leaf[top], "vec_id": ids[top], "score": s[top]})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = placed.mapInPandas(exact, "query_id long, leaf int, vec_id long, score double").where("score > double('-inf')").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()
    at = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(np.append(v, 0.0), sizes, tree.leaves, 0))} for i, v in zip(q_ids, q, strict=True)}
    needed = np.sort([at[int(i)][int(leaf)] + 1 for i, leaf in zip(truth["query_id"], truth["leaf"], strict=True)]) if len(truth) else np.array([1])
    least = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, v in zip(pdf["query_id"], pdf["v"], strict=True):
                leaves = tree.visits(np.append(np.frombuffer(v, "<f8"), 0.0), sizes, least, k + 1)
                yield pd.DataFrame({"query_id": int(i), "v": v, "leaf": leaves})

    walked = written(queries.repartition(spark.sparkContext.defaultParallelism * 4, "query_id").mapInPandas(walk, "query_id long, v binary, leaf int"), "walked")
    asks = {r["leaf"]: r["count"] for r in walked.groupBy("leaf").count().collect()}
    pieces = spark.createDataFrame([(i, max(1, -(-int(sizes[i]) // ROWS)), -(-n // ASKED)) for i, n in asks.items()], "leaf int, rows int, asks int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = placed.join(F.broadcast(pieces), "leaf").withColumn("r", part("vec_id", "rows")).withColumn("a", upto("asks")).select("leaf", "r", "a", "vec_id", "v")
    right = walked.join(F.broadcast(pieces), "leaf").withColumn("a", part("query_id", "asks")).withColumn("r", upto("rows")).select("leaf", "r", "a", "query_id", "v")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = list(_best(_matrix(x["v"].tolist()), x["vec_id"].to_numpy(), _matrix(y["v"].tolist()), y["query_id"].to_numpy(), k)) if len(x) and len(y) else []
        query, row, score = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": query, "vec_id": row, "score": score})

    keys = ["leaf", "r", "a"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
