"""Reading tables, shared scratch space and bounded training samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lean(spark: SparkSession) -> None:
    """Hand texts to Python in batches of few rows, as some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where it is unset, a temporary folder takes its place if driver and executors are one process; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/millrace-{what}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in the shared folder that cut the lineage of longer jobs, and their removal."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
        """df written as a table and read again; a lasting one, which a result still reads, outlives clear().

        Shuffle files of the job go when the table is there.
        """
        path, conf, tidy = fresh_path(self.spark, what), self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(tidy)
        conf.set(tidy, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(tidy, before)
        if not lasting:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *whats: str) -> None:
        """Remove the tables that nothing reads any more; all, or those of these names."""
        gone = [p for p in self.paths if not whats or any(f"/millrace-{w}-" in p for w in whats)]
        for path in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths = [p for p in self.paths if p not in gone]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    A lost executor then costs at most the running stage, and the reread table
    has true sizes, by which Spark chooses joins.
    """
    return Scratch(df.sparkSession).written(df, what, lasting=True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the held-out fold.

    The ids with the lowest hash of doc_id are taken, so the sample depends on
    neither partitioning nor order; of rows that repeat an id the greatest text
    is the one. The ids are at most `rows` pairs of numbers, hence the broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
