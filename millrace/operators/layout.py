"""Places on a page and in a recording: baselines, cells, anchors, gaps, stitched segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, key: str, order: list[str], step: Callable[[object, tuple], tuple[object, tuple]], columns: list[str], schema: str, reads: list[str] | None = None) -> DataFrame:
    """What a step gives for each row of a key in order, carrying a small state on; keys are sorted within partitions and stream by.

    The step is given the columns that it `reads`, else all; the others pass it by as Arrow has them. Values go to the step as Arrow gives
    them, so numbers beside nulls stay whole; rows of a null key share a state.
    """
    given = [0, *[1 + columns.index(c) for c in (columns if reads is None else reads)]]
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = (), None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in given], strict=True):
                if row[0] != at:
                    at, state = row[0], None
                state, said = step(state, row[1:])
                out.append(said)
            old = [c if c.type == ARROW[kind] else c.cast(ARROW[kind]) for c, (_, kind) in zip(batch.columns, fields, strict=False)]
            new = fields[len(old) :]
            said = [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(zip(*out, strict=True) if out else [()] * len(new), new, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *said], [name for name, _ in fields])

    # by a hash of the key, as Spark leaves out a shuffle by the key itself after a union of parts that are shuffled by it, and may then merge partitions of each part otherwise
    return rows.select(key, *columns).repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as Arrow has them, by a schema of plain kinds."""
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def lines(runs: DataFrame, page: str) -> DataFrame:
    """runs (page, y, height, id) with the number of their line: a run joins while it is within half the line's height of its baseline, and the height grows with the line."""

    def step(state, row):
        y, height, _ = row
        if state is None or abs(y - state[1]) > 0.5 * state[2]:
            state = ((state[0] + 1) if state else 0, y, height)
        else:
            state = (state[0], state[1], max(state[2], height))
        return state, (state[0],)

    return carried(runs, page, ["y", "id"], step, ["y", "height", "id"], f"{page} long, y double, height double, id long, line long")


def anchored(values: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """(key, value, cluster): sorted values; one more than the width from the first of its cluster begins another."""

    def step(state, row):
        n, first = state or (-1, None)
        if first is None or row[0] - first > width:
            n, first = n + 1, row[0]
        return (n, first), (n,)

    return carried(values, key, [value], step, [value], f"{key} long, {value} double, cluster long")


def stitched(segments: DataFrame, key: str, within: float) -> DataFrame:
    """segments (key, start, id, text) without those that say again, within so many seconds, what the last kept one said."""

    def step(state, row):
        start, _, text = row
        drop = state is not None and text == state[1] and abs(start - state[0]) <= within
        return (state if drop else (start, text)), (not drop,)

    out = carried(segments, key, ["start", "id"], step, ["start", "id", "text"], f"{key} long, start double, id long, text string, kept boolean")
    return out.where("kept").drop("kept")


def chunk_plan(length: Column, chunk: int, overlap: int) -> Column:
    """(start, end, keep_from, keep_until) of the pieces of a recording; overlaps are cut in the middle, the first and last pieces reach to the ends."""
    stride = chunk - overlap
    n = F.greatest(F.ceil((length - overlap) / stride), F.lit(1)).cast("int")
    piece = lambda i: F.struct(
        (i * stride).alias("start"), F.least(i * stride + chunk, length).alias("end"),
        F.when(i == 0, 0).otherwise(i * stride + overlap // 2).alias("keep_from"), F.when(i == n - 1, length).otherwise((i + 1) * stride + overlap // 2).alias("keep_until"),
    )
    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def cells(runs: DataFrame, key: str, left: str, right: str, gap: float) -> DataFrame:
    """runs with the number of their cell: a gap wider than `gap` from all before begins another."""
    by = Window.partitionBy(key).orderBy(left, right)
    reach = F.max(right).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("_new", F.when(F.col(left) - reach > gap, 1).otherwise(0))
    return fresh.withColumn("cell", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def widest_gap(spans: DataFrame, key: str, start: str, end: str, least: int) -> DataFrame:
    """(key, gap, at): the widest gap between a key's spans that is at least so wide, the first of equally wide ones."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, 0))
    gaps = spans.select(key, (F.lead(start).over(by) - reach).alias("gap"), reach.alias("at")).where(F.col("gap") >= least)
    return gaps.groupBy(key).agg(F.max(F.struct("gap", (-F.col("at")).alias("first"))).alias("g")).select(key, F.col("g.gap").alias("gap"), (-F.col("g.first")).alias("at"))
