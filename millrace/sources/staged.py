"""Tables of lines that are replaced whole or not at all: logs that are compacted in place, files that roll.

A store is a folder. Its rows lie in `part` folders by hash of a key, under
names that are never used twice; a small manifest, numbered and written last,
says which folders count. Until it is there readers see the version before, so
a lost executor costs the running stage and a lost driver leaves folders that
nothing names. A request carries a token: one that is repeated after it was
done changes nothing. Writers come one at a time: one that began at a version
which is no longer the newest is refused, but two that write their manifests at
the same moment aren't told apart.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import upkeep
from . import oplog
from .tables import written

TOKENS = 256  # requests that a manifest remembers
PIECES = 16  # folders of one part beyond which compaction merges them


class Store:
    """Rows of `schema` under `root`, in `parts` parts by hash of the columns `key`. A new store is an empty one; null keys have a part as any other."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], parts: int = 64):
        self.spark, self.root, self.schema, self.key, self.parts = spark, root.rstrip("/"), schema, key, parts

    def _path(self, *below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *below)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """The newest whole manifest: {"version", "folders": {part: [folder, ...]}, "tokens"}. One that a lost driver left torn counts as none."""
        for n in reversed(self._numbers()):
            text = self.spark.read.text(str(self._path("manifests", str(n))), wholetext=True).first()
            try:
                return json.loads(text[0]) if text else {}
            except ValueError:
                continue
        return {"version": 0, "folders": {}, "tokens": []}

    def part(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def rows(self, parts: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of the newest version; of some parts, if they are given. A version stays readable until clear() removes it."""
        folders = (manifest or self.manifest())["folders"]
        paths = [f"{self.root}/{f}/part={p}" for p, fs in folders.items() if parts is None or int(p) in parts for f in fs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame, token: str, replaces: list[int] | None = None, manifest: dict | None = None) -> bool:
        """Add rows, or let them take the place of all that the parts `replaces` hold; False if the token was done before.

        `manifest` is the version that the rows were made from: if another has come since, the request is refused.
        """
        old = manifest or self.manifest()
        if token in old["tokens"]:
            return False
        folder = f"rows-{uuid.uuid4().hex}"
        names = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        rows.select(*names).withColumn("part", self.part()).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.root}/{folder}")
        fs = self._fs()
        made = [int(s.getPath().getName()[5:]) for s in fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part=")]
        folders = {p: list(f) for p, f in old["folders"].items() if int(p) not in (replaces or [])}
        for p in made:
            folders.setdefault(str(p), []).append(folder)
        taken = self._numbers()
        if taken and taken[-1] > old["version"] and self.manifest()["version"] != old["version"]:
            raise RuntimeError(f"version {old['version']} of {self.root} is no longer the newest")
        number = (taken[-1] if taken else 0) + 1
        said = json.dumps({"version": number, "folders": folders, "tokens": [*old["tokens"], token][-TOKENS:]})
        out = fs.create(self._path("manifests", str(number)), False)
        out.write(bytearray(said.encode()))
        out.close()
        return True

    def clear(self) -> int:
        """Remove the folders that the newest version doesn't name, and older manifests; the number of folders removed. No other request may be running."""
        newest, fs = self.manifest(), self._fs()
        named = {f for fs_ in newest["folders"].values() for f in fs_}
        gone = [s.getPath() for s in fs.listStatus(self._path()) if s.getPath().getName().startswith("rows-") and s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        for n in self._numbers():
            if n < newest["version"]:
                fs.delete(self._path("manifests", str(n)), False)
        return len(gone)


def log_store(spark: SparkSession, root: str, parts: int = 64) -> Store:
    """Logs of collections as oplog reads them."""
    return Store(spark, root, "collection string, line long, raw string", ["collection"], parts)


def compact(store: Store, token: str, least_lines: int = 512, dead_share: float = 0.3) -> DataFrame:
    """Rewrite the logs that have earned it: at least `least_lines` lines, of which the dead are at least `dead_share`. Spoilt logs stay, as do lines without a collection.

    Only parts that hold such a log, or that lie in more than PIECES folders,
    are read again and written; in them logs that aren't due keep their lines.
    Returns (collection, lines, dead_lines, compacts, lines_after) of all logs as they were.
    """
    old = store.manifest()
    logs = oplog.state(store.rows(manifest=old))[1]
    due = F.coalesce(F.col("error").isNull() & (F.col("lines") >= least_lines) & (F.col("dead_lines") >= F.lit(dead_share) * F.col("lines")), F.lit(False))
    logs = written(logs.withColumn("compacts", due))
    said = logs.select("collection", "lines", "dead_lines", "compacts", F.when(due, F.col("chunks") + 1).otherwise(F.col("lines")).alias("lines_after"))
    if token in old["tokens"]:
        return said
    of_due = logs.where("compacts").select("collection")
    parts = {r[0] for r in of_due.select(store.part().alias("part")).distinct().collect()}  # at most as many as the store has parts
    parts = sorted(parts | {int(p) for p, f in old["folders"].items() if len(f) > PIECES})
    if parts:
        rows = store.rows(parts, old)
        rest = rows.join(of_due, "collection", "left_anti")
        fresh = oplog.compacted(rows.join(of_due, "collection", "left_semi"))
        store.put(rest.unionByName(fresh), token, parts, old)
    return said


def file_store(spark: SparkSession, root: str, parts: int = 64) -> Store:
    """Files of records and the files they rolled from: `generation` 0 is the file, 1 the one before it."""
    return Store(spark, root, "file string, generation int, number long, record string", ["file"], parts)


def append_records(store: Store, records: DataFrame, token: str, most: int) -> bool:
    """Append records (file, number, record) in order of number and record, a line each; a file that has something rolls before a record that would take it past `most` bytes.

    One generation is kept, so a file and the one before it are all that stays
    of what was written, at most twice `most` bytes or the longest record; that
    is why files which get records are written anew. A null record is an empty line; a record without a
    file stops the request. The store numbers a file's lines on and on.
    """
    old = store.manifest()
    if token in old["tokens"]:
        return False
    new = records.select("file", "number", F.coalesce("record", F.lit("")).alias("record"))
    if new.where("file is null").limit(1).count():
        raise ValueError("a record names no file")
    parts = sorted(r[0] for r in new.select(store.part().alias("part")).distinct().collect())
    held = store.rows(parts, old)
    weight = (F.octet_length("record") + 1).cast("long")
    # what a file holds goes before the new records as one write of its last number
    ends = held.groupBy("file").agg(F.max("number").alias("number"), F.sum(F.when(F.col("generation") == 0, weight)).alias("bytes"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("number", "record"))
    new = new.withColumn("_n", place).join(ends.select("file", F.col("number").alias("_end")), "file", "left")
    new = new.select("file", (F.coalesce("_end", F.lit(-1)) + F.col("_n")).cast("long").alias("number"), "record")
    rolled = upkeep.rolled(ends.unionByName(new.select("file", "number", weight.alias("bytes"))), "file", ["number"], most)
    newest = rolled.groupBy("file").agg(F.max("generation").alias("_last"))
    placed = new.join(rolled.select("file", "number", "generation"), ["file", "number"]).join(newest, "file")
    before = held.withColumn("generation", F.col("generation") * -1).join(newest, "file", "left")
    back = (F.coalesce("_last", F.lit(0)) - F.col("generation")).cast("int")
    kept = before.unionByName(placed).select("file", back.alias("generation"), "number", "record").where("generation <= 1")
    return store.put(kept, token, parts, old)


def write_files(store: Store, folder: str) -> None:
    """Write the store's files as text, one file for each and its generation, in folders file=.../generation=..., lines in order of number."""
    rows = store.rows()
    order = rows.repartition("file", "generation").sortWithinPartitions("file", "generation", "number")
    order.select("file", "generation", F.col("record").alias("value")).write.partitionBy("file", "generation").text(folder)

