"""Logs that come in frames: bodies cut into frames, and frames put together into lines.

A frame's end is no line's end: what a stream has left over goes on in its next
frame, whatever other streams say between. A line stands where the frame that
completes it stands; what has no end yet comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The streams of a frame's first byte.
STREAMS = {0: "stdin", 1: "stdout", 2: "stderr"}


def cut_frames(body: bytes) -> list[dict]:
    """The frames of a body: a byte for the stream, three zeros, four bytes of length, the payload.

    From where a header isn't one, the rest is one frame of the stream `merged`; a payload that ends early is kept, a header that does is left out.
    """
    out: list[dict] = []
    at = 0
    while at < len(body):
        head = body[at : at + 8]
        if len(head) < 8:
            return out or [{"stream": "merged", "payload": body}]
        if head[0] not in STREAMS or any(head[1:4]):
            return [*out, {"stream": "merged", "payload": body[at:]}]
        payload = body[at + 8 : at + 8 + int.from_bytes(head[4:], "big")]
        if payload:
            out.append({"stream": STREAMS[head[0]], "payload": payload})
        at += 8 + int.from_bytes(head[4:], "big")
    return out


def frames(bodies: DataFrame, container: str, body: str, tty: Column | None = None) -> DataFrame:
    """(container, frame, stream, payload) of bodies; those of a terminal are one frame of the stream `merged`. Null and empty bodies have none."""

    @F.pandas_udf("array<struct<stream:string,payload:binary>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([[] if b is None else cut_frames(bytes(b)) for b in bodies])

    framed = run(F.col(body)) if tty is None else F.when(tty & (F.length(body) > 0), F.array(F.struct(F.lit("merged").alias("stream"), F.col(body).alias("payload")))).otherwise(run(F.col(body)))
    return bodies.select(container, F.posexplode(framed).alias("frame", "f")).select(container, F.col("frame").cast("long"), "f.stream", "f.payload")


def lines(framed: DataFrame, container: str, most: int, most_characters: int, timestamps: bool = False) -> DataFrame:
    """(container, n, stream, stamp, text, cut, dropped): a container's last `most` lines in order, numbered from 0.

    dropped is the number of those before. Running counts of line ends give each piece of a payload its line, so a line over any number of
    frames meets in one group and nothing is carried from row to row; a stream's frames are sorted, its counts are all that is held.
    """
    stream = Window.partitionBy(container, "stream").orderBy("frame")
    pieces = F.split(F.make_valid_utf8(F.col("payload").cast("string")), "\n", -1)
    counted = framed.select(container, "stream", "frame", pieces.alias("p"))
    before = F.coalesce(F.sum(F.size("p") - 1).over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    appears = F.min("frame").over(Window.partitionBy(container, "stream"))
    numbered = counted.withColumns({"_before": before, "_appears": appears, "_ends": F.size("p") - 1})
    each = numbered.select(container, "stream", "frame", "_before", "_appears", "_ends", F.posexplode("p").alias("_i", "piece"))
    line = each.groupBy(container, "stream", "_appears", (F.col("_before") + F.col("_i")).alias("line")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "piece"))), lambda x: x["piece"]), "").alias("text"), F.max(F.when(F.col("_i") < F.col("_ends"), F.col("frame"))).alias("done")
    )
    whole = line.where("done is not null or text <> ''").withColumn("text", F.regexp_replace("text", "\r+$", ""))
    order = [F.col("done").isNull(), F.coalesce("done", "_appears"), F.col("line")]
    by = Window.partitionBy(container)
    n = F.row_number().over(by.orderBy(*order)) - 1
    dropped = F.greatest(F.count("*").over(by) - most, F.lit(0))
    kept = whole.withColumns({"n": n, "dropped": dropped}).where("n >= dropped")
    stamped = F.col("text").rlike(r"^[0-9]{4}-[^ ]*T[^ ]* ") & F.col("text").rlike(r"^([^ ]{19,}Z|[^ ]*\+[^ ]*) ") & (F.instr("text", " ") > 20) if timestamps else F.lit(False)
    rest = F.when(stamped, F.expr("substring(text, instr(text, ' ') + 1)")).otherwise(F.col("text"))
    long = F.length("_rest") > most_characters
    return kept.withColumns({"stamp": F.when(stamped, F.substring_index("text", " ", 1)), "_rest": rest}).select(
        container, "n", "stream", "stamp", F.when(long, F.concat(F.substring("_rest", 1, most_characters), F.lit("…"))).otherwise(F.col("_rest")).alias("text"), long.alias("cut"), "dropped"
    )
