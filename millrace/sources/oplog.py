"""Append-only logs of collections: lines of JSON replayed into the chunks in force, deletes of chunks and of whole documents.

A line is a `header` (model, width), a `put` (id, document, model, vector), a
`delete` (id) or a `delete_document` (document). A log begins with its only
header. The last line may be torn, as an append can be interrupted, and is then
left out; any other line that can't be read, a second header, and a put of
another model or width spoil the log, and the first such line is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

LINE = "op string, id string, document string, model string, width int, vector array<double>"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (collection, line, raw) with the fields of what they say and `error`; a torn last line has the error `torn`."""
    read = lines.withColumn("_p", F.from_json("raw", LINE)).select("collection", "line", "raw", "_p.*")
    # groupings of all lines keep numbers alone, which Spark hashes; those that keep texts or structs sort their rows, and come after them
    kinds = read.groupBy("collection", "model", "width").agg(F.min("line").alias("_first"), F.max("line").alias("_last"))
    ends = kinds.groupBy("collection").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.min_by(F.struct("model", "width"), "_first").alias("_head"))
    needs = {"header": F.col("model").isNotNull() & F.col("width").isNotNull(), "put": F.col("id").isNotNull() & F.col("document").isNotNull() & F.col("vector").isNotNull(), "delete": F.col("id").isNotNull(), "delete_document": F.col("document").isNotNull()}
    whole = F.coalesce(F.expr("false"), F.lit(False))
    for op, need in needs.items():
        whole = whole | ((F.col("op") == op) & need)
    bad, first, last = ~F.coalesce(whole, F.lit(False)), F.col("line") == F.col("_first"), F.col("line") == F.col("_last")
    error = (
        F.when(first & bad, "unreadable header").when(first & (F.col("op") != "header"), "no header").when(bad & last, "torn").when(bad, "unreadable")
        .when(~first & (F.col("op") == "header"), "second header").when((F.col("op") == "put") & ~F.col("model").eqNullSafe(F.col("_head.model")), "other model")
        .when((F.col("op") == "put") & (F.size("vector") != F.col("_head.width")), "other width")
    )
    return read.join(written(ends), "collection").withColumn("error", error).drop("_first", "_last", "_head")


def replayed(said: DataFrame) -> DataFrame:
    """(collection, id, document, line, vector) of the chunks in force, from parsed() lines of logs that aren't spoilt.

    A chunk's last put counts, unless a later line deletes it or its document: two groupings, a join with the puts that their numbers name,
    and one with the tombstones of documents. A put whose number is repeated counts once.
    """
    sound = said.where("error is null")
    put = F.col("op") == "put"
    last = sound.where("id is not null").groupBy("collection", "id").agg(F.max(F.when(put, F.col("line"))).alias("line"), F.max(F.when(F.col("op") == "delete", F.col("line"))).alias("gone"))
    live = last.where("line > coalesce(gone, -1)").select("collection", "id", "line")
    named = sound.where(put).select("collection", "id", "line", "document", "vector").join(live, ["collection", "id", "line"])
    puts = named.groupBy("collection", "id", "line").agg(F.max(F.struct("document", "vector")).alias("p")).select("collection", "id", "line", "p.*")
    stones = sound.where("op = 'delete_document'").groupBy("collection", "document").agg(F.max("line").alias("_dead"))
    return puts.join(stones, ["collection", "document"], "left").where("line > coalesce(_dead, -1)").select("collection", "id", "document", "line", "vector")


def state(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks in force, logs): logs has for each collection its lines, dead lines, chunks, and the first line that spoils it with why; a spoilt log has no chunks."""
    said = parsed(lines)
    kinds = said.groupBy("collection", "error").agg(F.count("*").alias("lines"), F.min("line").alias("line"))
    logs = kinds.groupBy("collection").agg(F.sum("lines").alias("lines"), F.min(F.when(F.col("error") != "torn", F.struct("line", "error"))).alias("_e"))
    logs = written(logs.select("collection", "lines", F.col("_e.line").alias("error_line"), F.col("_e.error").alias("error")))
    chunks = replayed(said.join(logs.where("error is null").select("collection"), "collection", "left_semi"))
    counts = chunks.groupBy("collection").agg(F.count("*").alias("_n"))
    n = F.when(F.col("error").isNull(), F.coalesce("_n", F.lit(0)))
    return chunks, logs.join(counts, "collection", "left").select("collection", "lines", n.alias("chunks"), (F.col("lines") - 1 - n).alias("dead_lines"), "error_line", "error")


def delete_documents(lines: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines to append, outcome) of a request to delete documents (collection, document).

    outcome has for each collection the documents and chunks deleted; a document that isn't there is none, appends nothing and is no error.
    Lines go on after the collection's last one, in order of the document.
    """
    chunks, logs = state(lines)
    held = chunks.groupBy("collection", "document").agg(F.count("*").alias("_chunks"))
    met = doomed.select("collection", "document").distinct().join(held, ["collection", "document"], "left")
    outcome = met.groupBy("collection").agg(F.count("_chunks").alias("documents_deleted"), F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunks_deleted"))
    outcome = outcome.join(logs.select("collection"), "collection", "left_semi")
    ends = lines.groupBy("collection").agg(F.max("line").alias("_end"))
    fresh = met.where("_chunks is not null").join(ends, "collection")
    number = F.col("_end") + F.row_number().over(Window.partitionBy("collection").orderBy("document"))
    raw = F.to_json(F.struct(F.lit("delete_document").alias("op"), "document"))
    return fresh.select("collection", number.alias("line"), raw.alias("raw")), outcome


def compacted(lines: DataFrame) -> DataFrame:
    """The lines of the same logs with nothing dead in them: the header and each chunk's last put, numbered anew in their order. Spoilt logs stay as they are."""
    chunks, logs = state(lines)
    sound = logs.where("error is null").select("collection")
    first = lines.groupBy("collection").agg(F.min("line").alias("line"))
    kept = chunks.select("collection", "line").union(first.join(sound, "collection", "left_semi").select("collection", "line"))
    number = F.row_number().over(Window.partitionBy("collection").orderBy("line")) - 1
    whole = lines.join(kept, ["collection", "line"], "left_semi").select("collection", number.cast("long").alias("line"), "raw")
    return whole.union(lines.join(sound, "collection", "left_anti").select("collection", F.col("line").cast("long").alias("line"), "raw"))
