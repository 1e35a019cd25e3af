"""Tables as files, log replay and inventories."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary folder serves a session of one process, and a cluster is refused."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again; Spark then knows its true size, and joins with a small one shuffle nothing."""
    path = f"{shared_folder(df.sparkSession)}/millrace-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(log: DataFrame, key: str, order: list[str], deleted: Column) -> DataFrame:
    """The rows in force after replaying an append-only log: each key's last, unless that deletes it."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & ~deleted).drop("_n")


def refresh(before: DataFrame, now: DataFrame, key: str, stamp: str) -> DataFrame:
    """(state, n): how many keys of two listings were added, removed, updated or left alone."""
    b, a = before.select(key, F.col(stamp).alias("_b")), now.select(key, F.col(stamp).alias("_a"))
    marks = (F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_a").isNull(), "removed").when(F.col("_b").eqNullSafe(F.col("_a")), "unchanged").otherwise("updated"))
    both = b.withColumn("_in_b", F.lit(1)).join(a.withColumn("_in_a", F.lit(1)), key, "full_outer")
    return both.groupBy(marks.alias("state")).agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with whole documents replaced by incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def contiguous(parts: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """(key, bytes, broken): received parts in order, and how many don't begin where the one before ends."""
    w = Window.partitionBy(key).orderBy(order, size)
    at = parts.withColumn("_ends", F.lag(F.col(order) + F.col(size)).over(w))
    return at.groupBy(key).agg(F.sum(size).alias("bytes"), F.sum(F.when(F.col("_ends") != F.col(order), 1).otherwise(0)).cast("long").alias("broken"))
