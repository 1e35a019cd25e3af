"""Runs of text placed on pages: lines, reading order by cuts between columns and blocks, tables.

Every function takes runs with (page long, id long, x, y, width, height double, text string), y upwards; other columns are left aside. A run
without a finite place, or whose text is blank or null, is none; a width below 0 is 0, a height of 0 or less is 1. Runs at one place go by id.
Rows without a page share one. Repeated rows stay. Pages are cut level by level, all pages at once; a region's rows are sorted and stream
by, so a page may hold more rows than a task's memory: that is done by windows for pages of more than MOST_HELD pieces, and the others, many
at once, by `placed`, whose rules are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, written
from .layout import carried
from .placed import ANCHOR, BLOCK, CELL, COLUMN_OVERLAP, FEWEST_LINES, FEWEST_RUNS, GUTTER_OF_WIDTH, LEAST_ANCHOR, MOST_CUTS, MOST_FILL, PITCH, WORD, gathered, next_line

# Pieces of a page beyond which its regions stream by in windows.
MOST_HELD = 1 << 17

_PLACE = ["x", "id", "text", "piece", "y", "right", "height"]  # rows alike in all of these are the same
_PIECE = "page long, path string, id long, y double, x double, right double, height double, text string, piece long, left double, end double, words string"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_LINES = "line long, said string"
_CELLS = "table long, row long, column long, columns long, rows long, filled long, cells array<string>"


def pieces(runs: DataFrame) -> DataFrame:
    """Runs cut where two spaces or more follow one another, each piece with its share of the width."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "width", "height")]
    good = runs.select("page", "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], "text")
    sound = reduce(lambda a, b: a & b, finite) & F.col("text").rlike(r"(?U)\S")
    width = F.greatest("width", F.lit(0.0))
    step = F.try_divide(width, F.length("text"))
    tokens = F.regexp_extract_all("text", F.lit("(  +|(?:[^ ]|(?<! ) (?! ))+)"), F.lit(1))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,words:string>>").alias("out"))
    cut = F.aggregate(tokens, begin, lambda s, t: F.struct((s["at"] + F.length(t)).alias("at"), F.when(t.rlike("^  "), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), t.alias("words"))))).alias("out")))["out"]
    # most runs have no two spaces side by side and are one piece; a run that is none has no piece, as a filter here would work out the columns of `runs` again for each of its parts
    cut = F.when(sound, F.when(F.contains("text", F.lit("  ")), cut).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.col("text").alias("words")))))
    each = good.select("page", "id", "y", "x", (F.col("x") + width).alias("right"), F.when(F.col("height") > 0, F.col("height")).otherwise(1.0).alias("height"), "text", step.alias("_step"), F.posexplode(cut).alias("piece", "_cut"))
    left = F.col("x") + F.col("_cut.at") * F.col("_step")
    return each.withColumns({"path": F.lit(""), "piece": F.col("piece").cast("long"), "left": left, "end": left + F.length("_cut.words") * F.col("_step"), "words": F.col("_cut.words")}).select(*_NAMES)


def _lined(rows: DataFrame) -> DataFrame:
    """rows with their region, line and, where there is a side, its line on that side alone; one pass from top to bottom."""
    none = (-1, 0.0, 0.0)

    def step(state, row):
        y, height, side = row
        whole, *sides = state or (none, none, none)
        whole = next_line(whole, y, height)
        if side is not None:
            sides[side] = next_line(sides[side], y, height)
        return (whole, *sides), (whole[0], None if side is None else sides[side][0])

    keyed = rows.withColumns({"region": F.concat(F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit("/"), "path"), "down": -F.col("y")})
    schema = f"region string, down double, {_PIECE}, side int, half string, line long, side_line long"
    return carried(keyed, "region", ["down", *_PLACE], step, ["down", *_NAMES, "side", "half"], schema, ["y", "height", "side"]).drop("down")


def _with_tables(lined: DataFrame, min_rows: int = 2, min_columns: int = 2) -> DataFrame:
    """lined with cells, groups of rows that could be a table, columns, and whether the group is one.

    Cell starts near the first of their cluster make a column; a column needs half of the rows, a table enough rows and columns, at most a fifth
    of its cells beside another in one place, and room: half of its cells must leave a fifth of the way to the next column empty, which
    columns of prose do not.
    """
    line = Window.partitionBy("region", "line")
    within = line.orderBy(*_PLACE)
    region = Window.partitionBy("region").orderBy("line", *_PLACE)
    so_far = Window.unboundedPreceding, 0
    d = lined.withColumns({"line_y": F.max("y").over(line), "line_h": F.max("height").over(line), "nth": F.row_number().over(within).cast("long"), "before": F.lag("end").over(within), "said": F.lag("words").over(within)})
    d = d.withColumn("first", F.col("nth") == 1).withColumn("begins", F.col("before").isNull() | (F.col("piece") > 0) | (F.col("left") - F.col("before") > CELL * F.greatest("line_h", F.lit(1.0))))
    one = F.col("begins").cast("long")
    d = d.withColumns({"cell": F.sum(one).over(within.rowsBetween(*so_far)), "tabular": F.sum(one).over(line) >= 2})
    d = d.withColumn("cell_end", F.last("end").over(Window.partitionBy("region", "line", "cell").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    far = F.coalesce(F.lag("line_y").over(region) - F.col("line_y") > PITCH * F.greatest(F.lag("line_h").over(region), "line_h", F.lit(1.0)), F.lit(False))
    d = d.withColumn("group", F.sum((F.col("first") & (~F.col("tabular") | far)).cast("long")).over(region.rowsBetween(*so_far)))

    g = Window.partitionBy("region", "group")
    tolerance = F.greatest(ANCHOR * F.greatest(F.max(F.when(F.col("tabular"), F.col("line_h"))).over(g), F.lit(1.0)), F.lit(LEAST_ANCHOR))
    d = d.withColumns({"tolerance": tolerance, "starts": F.col("begins") & F.col("tabular"), "rows": F.sum((F.col("first") & F.col("tabular")).cast("long")).over(g), "grouped": F.concat_ws("#", "region", "group")})

    def step(state, row):
        number, anchor = state or (-1, None)
        left, width, starts = row
        if not starts:
            return (number, anchor), (None, None)
        if anchor is None or left - anchor > width:
            number, anchor = number + 1, left
        return (number, anchor), (number, anchor)

    kept = f"region string, {_PIECE.replace('left double, ', '')}, side int, half string, line long, side_line long, line_y double, line_h double, nth long, first boolean, said string, begins boolean, cell long, tabular boolean, cell_end double, group long, rows long"
    columns = ["left", "tolerance", "starts", *[c.split()[0] for c in kept.split(", ")]]
    d = carried(d, "grouped", ["left", "line", *_PLACE], step, columns, f"grouped string, left double, tolerance double, starts boolean, {kept}, cluster long, anchor double", ["left", "tolerance", "starts"])

    clusters = g.orderBy(F.asc_nulls_first("cluster"))
    later, until = clusters.rangeBetween(1, Window.unboundedFollowing), clusters.rangeBetween(Window.unboundedPreceding, 0)

    def nearer(left: Column, low: Column, high: Column) -> Column:
        return F.when(low.isNull() | (high - left < left - low), high).otherwise(low)

    d = d.withColumn("column_at", F.when(F.col("starts"), nearer(F.col("left"), F.col("anchor"), F.min("anchor").over(later))))
    d = d.withColumn("_once", F.when(F.col("starts"), F.row_number().over(Window.partitionBy("region", "group", "column_at", "line").orderBy("left", *_PLACE)) == 1))
    d = d.withColumn("_filled", F.sum(F.col("_once").cast("long")).over(Window.partitionBy("region", "group", "column_at")))
    sure = F.when(F.col("starts") & (F.col("left") == F.col("anchor")) & (2 * F.col("_filled") >= F.col("rows")), F.col("anchor"))
    d = d.withColumn("_sure", sure).withColumns({"_low": F.max("_sure").over(until), "_high": F.min("_sure").over(later)})
    d = d.withColumn("at", F.when(F.col("starts"), nearer(F.col("left"), F.col("_low"), F.col("_high"))))
    d = d.withColumn("column", F.when(F.col("at").isNotNull(), F.dense_rank().over(g.orderBy(F.asc_nulls_last("at"))) - 1).cast("long"))
    band = F.min("at").over(g.orderBy(F.asc_nulls_first("column")).rangeBetween(1, Window.unboundedFollowing)) - F.col("at")
    d = d.withColumn("_fill", F.when(F.col("at").isNotNull() & (band > 0), F.least(F.greatest(F.col("cell_end") - F.col("at"), F.lit(0.0)) / band, F.lit(2.0))))
    d = d.withColumn("_alone", F.when(F.col("at").isNotNull(), F.row_number().over(Window.partitionBy("region", "group", "column", "line").orderBy("left", *_PLACE)) == 1))
    d = d.withColumns({"_nth": F.row_number().over(g.orderBy(F.asc_nulls_last("_fill"))), "_fills": F.count("_fill").over(g), "columns": F.max("column").over(g) + 1, "cells": F.sum(F.col("starts").cast("long")).over(g), "filled": F.sum(F.col("_alone").cast("long")).over(g)})
    fill = F.max(F.when(F.expr("_nth = _fills div 2 + 1"), F.col("_fill"))).over(g)
    found = (F.col("rows") >= max(min_rows, 2)) & (F.col("columns") >= max(min_columns, 2)) & (5 * (F.col("cells") - F.col("filled")) <= F.col("cells")) & (F.coalesce(fill, F.lit(0.0)) <= MOST_FILL)
    return d.withColumn("is_table", F.coalesce(F.col("tabular") & found, F.lit(False))).drop("_once", "_filled", "_sure", "_low", "_high", "_fill", "_alone", "_nth", "_fills", "grouped", "tolerance")


def _sides(rows: DataFrame) -> DataFrame:
    """rows with `side`, 0 or 1, of the gutter of a region whose sides stand side by side, and `half`, c or d, above or below its widest gap; null without one."""
    r = Window.partitionBy("page", "path")
    run = F.col("piece") == 0
    top = F.col("y") + F.col("height")
    d = rows.withColumns({"_n": F.sum(run.cast("long")).over(r), "_nth": F.row_number().over(r.orderBy(~run, "height")), "_width": F.greatest(F.max("right").over(r) - F.min("x").over(r), F.lit(1.0))})
    d = d.withColumn("_high", F.max(F.when(F.expr("_nth = _n div 2 + 1"), F.col("height"))).over(r))

    def widest(start: str, end: Column, least: Column) -> Column:
        reach = F.max(end).over(r.orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
        return F.when(F.col(start) - reach >= least, F.struct((F.col(start) - reach).alias("gap"), ((F.col(start) + reach) / 2).alias("at")))

    d = d.withColumns({"_g": widest("x", F.col("right"), F.greatest(GUTTER_OF_WIDTH * F.col("_width"), "_high")), "_b": widest("y", top, F.greatest(BLOCK * F.col("_high"), F.lit(1.0)))})
    d = d.withColumns({"_gutter": F.max("_g").over(r)["at"], "_block": F.max("_b").over(r)["at"]})
    d = d.withColumn("side", F.when((F.col("_n") >= FEWEST_RUNS) & F.col("_gutter").isNotNull(), F.when(F.col("right") <= F.col("_gutter"), 0).otherwise(1)).cast("int"))
    low, high = ([f(F.when(F.col("side") == s, c)).over(r) for s in (0, 1)] for f, c in ((F.min, F.col("y")), (F.max, top)))
    shorter = F.least(high[0] - low[0], high[1] - low[1])
    shared = F.when(shorter > 0, (F.least(*high) - F.greatest(*low)) / shorter).otherwise(0.0)
    d = d.withColumn("_shared", F.coalesce(shared, F.lit(0.0)) >= COLUMN_OVERLAP)
    half = F.when((F.col("_n") >= FEWEST_RUNS) & F.col("_block").isNotNull(), F.when(F.col("y") >= F.col("_block"), "c").otherwise("d"))
    return d.withColumns({"half": half, "side": F.when(F.col("_shared"), F.col("side"))}).select(*_NAMES, "side", "half")


def _judged(rows: DataFrame) -> DataFrame:
    """rows of regions that have sides, whose half is now a or b where the region is cut at its gutter: both sides have lines enough and it is no table."""
    asked = _with_tables(_lined(rows))
    g = Window.partitionBy("region")
    lines = [F.max(F.when(F.col("side") == s, F.col("side_line"))).over(g) + 1 >= FEWEST_LINES for s in (0, 1)]
    all_lines = F.max("line").over(g) + 1
    tables = F.coalesce(F.sum((F.col("is_table") & F.col("first")).cast("long")).over(g), F.lit(0))
    split = lines[0] & lines[1] & ~((all_lines >= FEWEST_LINES) & (10 * tables >= 6 * all_lines))
    half = F.when(F.coalesce("_split", F.lit(False)), F.when(F.col("side") == 0, "a").otherwise("b")).otherwise(F.col("half"))
    return asked.withColumn("_split", split).select(*_NAMES, half.alias("half"))


def regions(at: DataFrame) -> DataFrame:
    """Pieces with the path of their region; paths in order of text are the reading order.

    A region of at least eight runs is cut at its widest gutter, if both sides have three lines, stand side by side and are no table, else at
    its widest gap from side to side; six cuts deep at most. Each level is written before the next begins, in two steps: the places of its
    cuts, and what comes of regions with sides, if there are any.
    """
    done = []
    for _ in range(MOST_CUTS):
        level = cut_lineage(_sides(at))
        asked = level.where("side is not null")
        judged = [] if asked.isEmpty() else [cut_lineage(_judged(asked))]
        parts = [level.where("side is null"), *judged]
        done += [p.where("half is null").select(*_NAMES) for p in parts]
        cut = [p.where("half is not null").select(*[F.concat("path", "half").alias(c) if c == "path" else c for c in _NAMES]) for p in parts]
        at = reduce(DataFrame.unionByName, cut)
        if at.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, at])


def _uncut(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"side": F.lit(None).cast("int"), "half": F.lit(None).cast("string")})


def _placed(runs: DataFrame, in_tables: bool, min_rows: int = 2, min_columns: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """Lines, or cells of tables, of the pages that may be held, and the pieces of the others, if there are any."""
    most = MOST_HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(batches, in_tables, min_rows, min_columns, most)

    # by a hash, as in `carried`
    sorted_pages = pieces(runs.repartition(F.xxhash64("page"))).sortWithinPartitions("page", *_PLACE)
    kinds = [*[f for f in _PIECE.split(", ") if not f.startswith("path ")], "path string", _CELLS if in_tables else _LINES]
    got = written(sorted_pages.mapInArrow(run, ", ".join(kinds)))
    rest = got.where("piece is not null").select(*_NAMES)
    return got.where("piece is null"), None if rest.isEmpty() else rest


def reading_lines(runs: DataFrame) -> DataFrame:
    """(page, path, line, text) of every line in its region; runs a word's space apart are set apart by one."""
    got, rest = _placed(runs, False)
    said = got.select("page", "path", "line", "said")
    if rest is not None:
        lined = _lined(_uncut(regions(rest))).where("piece = 0")
        line = Window.partitionBy("region", "line")
        within = line.orderBy(*_PLACE)
        apart = F.col("x") - F.lag("right").over(within) > WORD * F.greatest(F.max("height").over(line), F.lit(1.0))
        spaced = F.lag("text").over(within).rlike(r"(?U)\s$") | F.col("text").rlike(r"(?U)^\s")
        parts = lined.withColumns({"_nth": F.row_number().over(within), "_part": F.concat(F.when(apart & ~spaced, " ").otherwise(""), "text")})
        more = parts.groupBy("page", "path", "line").agg(F.array_sort(F.collect_list(F.struct("_nth", "_part"))).alias("_p"))
        said = said.unionByName(more.select("page", "path", "line", F.array_join("_p._part", "").alias("said")))
    return said.select("page", "path", "line", F.regexp_replace("said", r"(?U)\s+$", "").alias("text"))


def page_texts(runs: DataFrame, most: int | None = None) -> DataFrame:
    """(page, text, columns, lines, truncated): a page's text in reading order, an empty line between regions, at most so many characters; pages without text have no row."""
    got = reading_lines(runs).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("path", "line", "text"))).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda l, i: F.concat(F.when(i == 0, "").when(l["line"] == 0, "\n\n").otherwise("\n"), l["text"])), "")
    gutters = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("_l.path"), lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.length(p)), lambda i: F.substr(p, F.lit(1), i)), lambda s: F.endswith(s, F.lit("a")))))))
    text = joined if most is None else F.substr(joined, F.lit(1), F.lit(most))
    return got.select("page", text.alias("text"), (gutters + 1).cast("long").alias("columns"), F.size("_l").cast("long").alias("lines"), (F.lit(False) if most is None else F.length(joined) >= most).alias("truncated"))


def tables(runs: DataFrame, min_rows: int = 2, min_columns: int = 2) -> DataFrame:
    """(page, table, row, column, text, columns, rows, occupancy) of the filled cells of every table, numbers from 0, tables in reading order; cells of a row that share a column are joined. No bound on rows or columns."""
    got, rest = _placed(runs, True, min_rows, min_columns)
    columns = ["page", "table", "row", "column", "columns", "rows", "filled"]
    trimmed = lambda text: F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    filled = got.select(*columns, F.array_join(F.transform("cells", trimmed), " ").alias("text"))
    if rest is not None:
        marks = _with_tables(_lined(_uncut(regions(rest))), min_rows, min_columns).where("is_table")
        glue = F.when(F.col("begins") | F.endswith("said", F.lit(" ")), "").otherwise(" ")
        cell = marks.withColumn("_part", F.concat(glue, "words")).groupBy("page", "path", "group", "line", "cell").agg(F.array_sort(F.collect_list(F.struct("nth", "_part"))).alias("_p"), F.max("column").alias("column"), F.max("columns").alias("columns"), F.max("rows").alias("rows"), F.max("filled").alias("filled"))
        cells = cell.withColumn("_t", trimmed(F.array_join("_p._part", "")))
        placed = cells.groupBy("page", "path", "group", "line", "column").agg(F.array_sort(F.collect_list(F.struct("cell", "_t"))).alias("_c"), *[F.max(c).alias(c) for c in ("columns", "rows", "filled")])
        table = F.dense_rank().over(Window.partitionBy("page").orderBy("path", "group")) - 1
        row = F.dense_rank().over(Window.partitionBy("page", "path", "group").orderBy("line")) - 1
        filled = filled.unionByName(placed.select("page", table.cast("long").alias("table"), row.cast("long").alias("row"), "column", "columns", "rows", "filled", F.array_join("_c._t", " ").alias("text")))
    return filled.select("page", "table", "row", "column", "text", "columns", "rows", (F.col("filled") / (F.col("columns") * F.col("rows"))).alias("occupancy"))
