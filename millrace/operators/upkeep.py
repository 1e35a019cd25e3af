"""Upkeep of stores and peers: what to compact, when a file rolls, grants of bytes, what peers begin and cease to serve, groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import carried


def compaction(log: DataFrame, collection: str, key: str, order: list[str], deleted: Column, least_lines: int = 512, dead_share: float = 0.3) -> DataFrame:
    """(collection, log_lines, dead_lines, compacts, lines_after) of append-only logs with a header line each.

    A line is dead if a later one of its key replaces it or if it deletes. Both sums combine before their shuffle, so a hot key costs a row a task.
    """
    last = log.groupBy(collection, key).agg(F.count("*").alias("n"), F.max_by(deleted, F.struct(*order)).alias("gone"))
    sums = last.groupBy(collection).agg((F.sum("n") + 1).alias("log_lines"), F.count_if(~F.col("gone")).alias("live"))
    dead = F.col("log_lines") - 1 - F.col("live")
    due = (F.col("log_lines") >= least_lines) & (dead / F.col("log_lines") >= dead_share)
    return sums.select(collection, "log_lines", dead.alias("dead_lines"), due.alias("compacts"), F.when(due, F.col("live") + 1).otherwise(F.col("log_lines")).alias("lines_after"))


def rolled(writes: DataFrame, file: str, order: list[str], most: int) -> DataFrame:
    """writes (file, *order, bytes) with `rotated` and `generation`: a file that has something rolls before a write that would take it past `most` bytes."""

    def step(state, row):
        size, generation = state or (0, 0)
        roll = size > 0 and size + row[-1] > most
        state = (row[-1], generation + 1) if roll else (size + row[-1], generation)
        return state, (roll, state[1])

    kind = "string" if dict(writes.dtypes)[file] == "string" else "long"
    return carried(writes, file, order, step, [*order, "bytes"], f"{file} {kind}, {', '.join(f'{o} long' for o in order)}, bytes long, rotated boolean, generation long")


def byte_grants(asks: DataFrame, key: str, now: str, event: str, want: str, capacity: int, per_minute: int) -> DataFrame:
    """asks with `granted` and `left`: a key's bucket begins full, grants what it has, and keeps the remainder of a refill; a clock that goes back adds nothing."""

    def step(state, row):
        at, _, wanted = row
        had, rest, last = state or (capacity, 0, at)
        gained, rest = divmod(max(0, at - last) * per_minute + rest, 60_000)
        had = min(capacity, had + gained)
        granted = min(wanted, had)
        return (had - granted, rest, max(last, at)), (granted, had - granted)

    return carried(asks, key, [now, event], step, [now, event, want], f"{key} long, {now} long, {event} long, {want} long, granted long, left long")


def transitions(sightings: DataFrame, peer: str, order: list[str], models: str, down: Column) -> DataFrame:
    """sightings with `added` and `removed` models: the first sighting of a peer, or the first after it went down, says nothing; going down removes all it served."""
    none = F.array().cast("array<string>")
    before = F.lag(F.when(~down, F.array_distinct(models))).over(Window.partitionBy(peer).orderBy(*order))
    seen = sightings.withColumn("_down", down).withColumn("_before", before)
    added = F.when(F.col("_down") | F.col("_before").isNull(), none).otherwise(F.array_except(models, "_before"))
    removed = F.when(F.col("_before").isNull(), none).when(F.col("_down"), F.col("_before")).otherwise(F.array_except("_before", models))
    return seen.withColumn("added", F.array_sort(added)).withColumn("removed", F.array_sort(removed)).drop("_down", "_before")


def tracked(sightings: DataFrame, tracker: str, order: list[str], capacity: int) -> DataFrame:
    """transitions() by a tracker that holds at most `capacity` peers: of (tracker, *order, peer, models, down), models joined by commas, a newcomer to a full one says nothing."""

    def step(state, row):
        serving = state if state is not None else {}
        peer, models, down = row[-3:]
        now, before = set(filter(None, models.split(","))), serving.get(peer)
        if down:
            serving.pop(peer, None)
            return serving, ("", ",".join(sorted(before or ())))
        if before is None and len(serving) >= capacity:
            return serving, ("", "")
        serving[peer] = now
        return serving, ("", "") if before is None else (",".join(sorted(now - before)), ",".join(sorted(before - now)))

    names = ", ".join(f"{o} long" for o in order)
    return carried(sightings, tracker, order, step, [*order, "peer", "models", "down"], f"{tracker} long, {names}, peer long, models string, down boolean, added string, removed string")


def row_groups(lines: DataFrame, page: str, y: str, order: list[str], height: str, cells: str, pitch: float = 2.5) -> DataFrame:
    """(page, first_y, last_y, rows): runs of at least two lines with two cells or more each, no line further below the one before than `pitch` heights."""
    by = Window.partitionBy(page).orderBy(F.desc(y), *order)
    far = F.lag(y).over(by) - F.col(y) > pitch * F.greatest(F.lag(height).over(by), F.col(height), F.lit(1.0))
    tabular = F.col(cells) >= 2
    marked = lines.withColumn("_table", tabular).withColumn("_cut", F.when(~tabular | F.coalesce(far, F.lit(False)), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_table")
    return runs.groupBy(page, "_run").agg(F.max(y).alias("first_y"), F.min(y).alias("last_y"), F.count("*").alias("rows")).where("rows >= 2").drop("_run")
