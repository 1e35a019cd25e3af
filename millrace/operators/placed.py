"""Many whole pages at once as columns of numbers: the cuts, lines and tables of `pages`, in order of page within a task.

A part of a task's rows, some tens of thousands, is worked out in one go; equal keys that follow one another are a group, and what is said of
a group is said by a reduction over its rows. The rules and their bounds are those of `pages`, whose windows also do the pages that are left out here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bounds on what is a line, a word, a cell, a column, a block and a table, most in heights of a line.
MOST_CUTS, FEWEST_RUNS, FEWEST_LINES = 6, 8, 3
LINE, WORD, CELL, BLOCK, PITCH = 0.5, 0.22, 0.75, 1.2, 2.5
GUTTER_OF_WIDTH, COLUMN_OVERLAP = 0.03, 0.5
ANCHOR, LEAST_ANCHOR, MOST_FILL = 0.4, 4.0, 0.8

# Rows that are worked out in one go; bytes of a page beyond which, and places beyond which, it is left to windows.
TOGETHER, MOST_BYTES, FARTHEST = 1 << 16, 1 << 26, 1e100


def fresh(*keys: np.ndarray) -> np.ndarray:
    """Whether a row begins a group, that is, whether any key differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def over(reduce: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A reduction over each row's group, on every row."""
    return reduce.reduceat(values, np.flatnonzero(first))[np.cumsum(first) - 1]


def count(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return over(np.add, flags.astype(np.int64), first)


def running(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set up to each row of its group."""
    total, at = np.cumsum(flags), np.flatnonzero(first)
    return total - (total[at] - flags[at])[np.cumsum(first) - 1]


def before(values: np.ndarray) -> np.ndarray:
    return np.roll(values, 1)


def widest(start: np.ndarray, end: np.ndarray, least: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The middle of the widest gap between the spans of each group, the last of equally wide ones; not a number without one. Rows are in order of start."""
    order = np.argsort(end, kind="stable")
    rank = np.empty(len(end), np.int64)
    rank[order] = np.arange(len(end))
    group = np.cumsum(first) - 1
    reach = before(end[order][np.maximum.accumulate(rank + group * len(end)) - group * len(end)])
    gap = np.where(first | ~(start - reach >= least), -np.inf, start - reach)
    best = over(np.maximum, gap, first)
    at = over(np.maximum, np.where((gap == best) & (gap > -np.inf), (start + reach) / 2, -np.inf), first)
    return np.where(best > -np.inf, at, np.nan)


def next_line(state: tuple, y: float, height: float) -> tuple:
    """The line a run stands in: its number, the baseline of its first run, its height so far."""
    number, base, high = state
    if number >= 0 and abs(base - y) <= LINE * max(high, height):
        return number, base, max(high, height)
    return number + 1, y, height


def lines(region: np.ndarray, y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The line of each row in its region; rows of a region come in order of place."""
    order = np.lexsort((-y, region))
    said, number, base, high = [], 0, 0.0, 0.0
    # as `next_line`, from top to bottom, without a call for each row
    for new, at, tall in zip(fresh(region[order]).tolist(), y[order].tolist(), height[order].tolist(), strict=True):
        if new:
            number, base, high = 0, at, tall
        else:
            high = tall if tall > high else high
            if base - at > LINE * high:
                number, base, high = number + 1, at, tall
        said.append(number)
    out = np.empty(len(y), np.int64)
    out[order] = said
    return out


def sides(region: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The side of the gutter, 0 or 1, else -1, and the half, 3 or 4, above or below the widest gap, else 0. Rows come by region, then x."""
    first, run, top = fresh(region), c["piece"] == 0, c["y"] + c["height"]
    begin, n = np.flatnonzero(first), count(run, first)
    middle = c["height"][np.lexsort((c["height"], ~run, region))][begin + n[begin] // 2]
    high = middle[np.cumsum(first) - 1]
    width = np.maximum(over(np.maximum, c["right"], first) - over(np.minimum, c["x"], first), 1.0)
    gutter = widest(c["x"], c["right"], np.maximum(GUTTER_OF_WIDTH * width, high), first)
    down = np.lexsort((c["y"], region))
    block = np.empty(len(top))
    block[down] = widest(c["y"][down], top[down], np.maximum(BLOCK * high, 1.0), first)
    side = np.where((n >= FEWEST_RUNS) & ~np.isnan(gutter), np.where(c["right"] <= gutter, 0, 1), -1)
    low = [over(np.minimum, np.where(side == s, c["y"], np.inf), first) for s in (0, 1)]
    tall = [over(np.maximum, np.where(side == s, top, -np.inf), first) for s in (0, 1)]
    shorter = np.minimum(tall[0] - low[0], tall[1] - low[1])
    shared = (side >= 0) & (shorter > 0) & ((np.minimum(*tall) - np.maximum(*low)) / shorter >= COLUMN_OVERLAP)
    half = np.where((n >= FEWEST_RUNS) & ~np.isnan(block), np.where(c["y"] >= block, 3, 4), 0)
    return np.where(shared, side, -1), half


def tables(region: np.ndarray, line: np.ndarray, c: dict[str, np.ndarray], min_rows: int, min_columns: int) -> dict[str, np.ndarray]:
    """Cells, groups, columns and whether a row is of a table, as in `pages._with_tables`. Rows come by region, line, place."""
    outer = fresh(region)
    first = outer | fresh(line)
    line_y, line_h = over(np.maximum, c["y"], first), over(np.maximum, c["height"], first)
    begins = first | (c["piece"] > 0) | (c["left"] - before(c["end"]) > CELL * np.maximum(line_h, 1.0))
    tabular = count(begins, first) >= 2
    ends = np.append(np.flatnonzero(begins)[1:], len(begins)) - 1
    cell_end = c["end"][ends][np.cumsum(begins) - 1]
    far = ~outer & (before(line_y) - line_y > PITCH * np.maximum(np.maximum(before(line_h), line_h), 1.0))
    parted = first & (~tabular | far)
    grouped = outer | parted
    rows = count(first & tabular, grouped)
    tolerance = np.maximum(ANCHOR * over(np.maximum, np.where(tabular, np.maximum(line_h, 1.0), 1.0), grouped), LEAST_ANCHOR)
    out = {"first": first, "begins": begins, "cell": running(begins, first), "group": running(parted, outer), "rows": rows}

    # from here on the cells of lines that have two, by group and left
    kept = np.flatnonzero(begins & tabular)
    if not len(kept):
        none = np.zeros(len(region), np.int64)
        return out | {"column": none - 1, "columns": none, "filled": none, "is_table": np.zeros(len(region), bool)}
    group = (np.cumsum(grouped) - 1)[kept]
    order = np.lexsort((c["left"][kept], group))
    kept, group = kept[order], group[order]
    left, at_line, new = c["left"][kept], line[kept], fresh(group)

    own, anchor, begun = [], 0.0, []
    for i, (begin, place, wide) in enumerate(zip(new.tolist(), left.tolist(), tolerance[kept].tolist(), strict=True)):
        if begin or place - anchor > wide:
            anchor = place
            begun.append(i)
        own.append(len(begun) - 1)
    own, anchor, of = np.array(own), left[begun], group[begun]
    last = np.append(of[1:] != of[:-1], True)

    def nearer(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the two anchors, -1 being none, the one that is nearer to the left, the lower of equally near ones."""
        up = anchor[high] - left < left - anchor[low]
        return np.where(low < 0, high, np.where((high >= 0) & up, high, low))

    def distinct(where: np.ndarray) -> np.ndarray:
        """By anchor, in how many lines it has cells; -1 is none."""
        some, wide = where >= 0, at_line.max() + 1
        return np.bincount(np.unique(where[some] * wide + at_line[some]) // wide, minlength=len(anchor))

    number = np.arange(len(anchor))
    home = nearer(own, np.where(last, -1, number + 1)[own])
    good = 2 * distinct(home) >= rows[kept][begun]
    low, high = np.maximum.accumulate(np.where(good, number, -1)), np.minimum.accumulate(np.where(good, number, len(number))[::-1])[::-1]
    high = np.append(high[1:], len(number))
    low, high = np.where((low >= 0) & (of[low] == of), low, -1), np.where(high < len(number), high, -1)
    high = np.where((high >= 0) & (of[high] == of), high, -1)
    at = nearer(low[own], high[own])

    before_it = np.cumsum(good) - good
    column = np.where(at >= 0, before_it[at] - over(np.minimum, before_it[own], new), -1)
    band = np.where(high >= 0, anchor[high] - anchor, np.nan)[at]
    fill = np.where((at >= 0) & (band > 0), np.minimum(np.maximum(cell_end[kept] - anchor[at], 0.0) / band, 2.0), np.nan)
    n, begin = count(~np.isnan(fill), new), np.flatnonzero(new)
    half = fill[np.lexsort((fill, np.isnan(fill), group))][np.minimum(begin + n[begin] // 2, len(fill) - 1)][np.cumsum(new) - 1]
    columns, cells = over(np.maximum, column, new) + 1, count(np.ones(len(new), bool), new)
    filled = np.bincount(of, weights=distinct(at), minlength=group[-1] + 1).astype(np.int64)[group]
    found = (rows[kept] >= max(min_rows, 2)) & (columns >= max(min_columns, 2)) & (5 * (cells - filled) <= cells) & (np.where(n > 0, half, 0.0) <= MOST_FILL)

    def back(values: np.ndarray, none: int) -> np.ndarray:
        """What is said of groups, for all of their rows."""
        all_of = np.full(int(np.sum(grouped)), none, np.int64)
        all_of[group] = values
        return all_of[np.cumsum(grouped) - 1]

    in_column = np.full(len(region), -1, np.int64)
    in_column[kept] = column
    return out | {"column": in_column, "columns": back(columns, 0), "filled": back(filled, 0), "is_table": tabular & (back(found, 0) > 0)}


def split(region: np.ndarray, side: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """Whether a region with sides is cut at its gutter, on every row: both sides have lines enough and it is no table. Rows come by region, then place."""
    first = fresh(region)
    line, beside = lines(region, c["y"], c["height"]), lines(2 * region + side, c["y"], c["height"])
    order = np.lexsort((line, region))
    marks = tables(region[order], line[order], {k: v[order] for k, v in c.items()}, 2, 2)
    in_tables, depth = count(marks["is_table"] & marks["first"], first), over(np.maximum, line, first) + 1
    enough = [over(np.maximum, np.where(side == s, beside, -1), first) + 1 >= FEWEST_LINES for s in (0, 1)]
    return enough[0] & enough[1] & ~((depth >= FEWEST_LINES) & (10 * in_tables >= 6 * depth))


def paths(page: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
    """The path of each row's region as digits to the base of five, a to d as 1 to 4. Rows come by page, then place."""
    path, rows = np.zeros(len(page), np.int64), np.arange(len(page))
    deepest = 5**MOST_CUTS
    for _ in range(MOST_CUTS):
        rows = rows[np.argsort(page[rows] * deepest + path[rows], kind="stable")]
        region = page[rows] * deepest + path[rows]
        here = {k: v[rows] for k, v in c.items()}
        side, half = sides(region, here)
        asked = np.flatnonzero(side >= 0)
        if len(asked):
            cut = split(region[asked], side[asked], {k: v[asked] for k, v in here.items()})
            half[asked] = np.where(cut, side[asked] + 1, half[asked])
        path[rows] = np.where(half > 0, 5 * path[rows] + half, path[rows])
        rows = rows[half > 0]
        if not len(rows):
            break
    return path


def named(path: np.ndarray) -> pa.Array:
    """Paths as text."""
    codes, at = np.unique(path, return_inverse=True)
    names = []
    for code in codes.tolist():
        name = ""
        while code:
            code, digit = divmod(code, 5)
            name = ("abcd"[digit - 1] if digit else "") + name
        names.append(name)
    return pa.array(names, pa.string()).take(pa.array(at))


def joined(words: pa.Array, apart: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each group one after another, those that are apart from the ones before behind a space."""
    if np.any(apart):
        words = pc.if_else(pa.array(apart), pc.binary_join_element_wise("", words, " "), words)
    return words if np.all(first) else pc.binary_join(listed(words, first), "")


def listed(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(first), len(first)), pa.int32()), values)


def changes(page: pa.Array) -> np.ndarray:
    """Where a page's first row is; rows without a page share one."""
    return fresh(page.fill_null(0).to_numpy(zero_copy_only=False), page.is_null().to_numpy(zero_copy_only=False))


def parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows by page as parts of whole pages, and those of pages of more rows or bytes than may be held, which are marked."""
    held, rows, crowded = [], 0, None

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if crowded is not None:
            same = np.flatnonzero(changes(pa.concat_arrays([crowded, batch["page"]]))[1:])
            till = int(same[0]) if len(same) else batch.num_rows
            if till:
                yield batch.slice(0, till), True
            if till == batch.num_rows:
                continue
            batch, crowded = batch.slice(till), None
        held.append(batch)
        rows += batch.num_rows
        if rows < min(TOGETHER, most) and sum(b.nbytes for b in held) < MOST_BYTES:
            continue
        whole = together()
        last = int(np.flatnonzero(changes(whole["page"]))[-1])
        yield from apart(whole.slice(0, last), most)
        rest = whole.slice(last)
        if rest.num_rows > most or rest.nbytes > MOST_BYTES:
            yield rest, True
            held, rows, crowded = [], 0, rest["page"].slice(0, 1)
        else:
            held, rows = [rest], rest.num_rows
    if held:
        yield from apart(together(), most)


def apart(whole: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Whole pages; those of more rows than may be held, or with places so far away that differences overflow, are marked."""
    if not whole.num_rows:
        return
    first = changes(whole["page"])
    far = np.max([np.abs(whole[k].to_numpy()) for k in ("x", "y", "right", "height", "left", "end")], axis=0)
    wild = (count(np.ones(len(first), bool), first) > most) | (over(np.maximum, np.where(far <= FARTHEST, 0, 1), first) > 0)
    for mark in (False, True):
        if np.any(wild == mark):
            yield (whole if np.all(wild == mark) else whole.filter(pa.array(wild == mark))), mark


# What whole pages give: lines with their text, or cells of tables with the texts that share the cell.
LINES = {"path": pa.string(), "line": pa.int64(), "said": pa.string()}
CELLS = {"table": pa.int64(), "row": pa.int64(), "column": pa.int64(), "columns": pa.int64(), "rows": pa.int64(), "filled": pa.int64(), "cells": pa.list_(pa.string())}
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def placed(batch: pa.RecordBatch, in_tables: bool, min_rows: int, min_columns: int) -> dict[str, pa.Array]:
    """The lines or the cells of tables of whole pages; rows come by page, then place."""
    c = {k: batch[k].to_numpy() for k in ("x", "y", "right", "height", "left", "end", "piece")}
    page, path = np.cumsum(changes(batch["page"])) - 1, paths(np.cumsum(changes(batch["page"])) - 1, c)
    for _ in range(MOST_CUTS - 1):  # in order of text
        path = np.where(path * 5 < 5**MOST_CUTS, path * 5, path)
    order = np.lexsort((path, page))
    region = (page * 5**MOST_CUTS + path)[order]
    line = lines(region, c["y"][order], c["height"][order])
    by_line = np.lexsort((line, region))
    order, region, line = order[by_line], region[by_line], line[by_line]
    c = {k: v[order] for k, v in c.items()}
    if not in_tables:
        own = np.flatnonzero(c["piece"] == 0)
        text, first = batch["text"].take(pa.array(order[own])), fresh(region[own], line[own])
        high = over(np.maximum, c["height"][own], first)
        ends, starts = (pc.match_substring_regex(text, s).to_numpy(zero_copy_only=False) for s in (_SPACE + r"\z", r"\A" + _SPACE))
        apart_ = ~first & (c["x"][own] - before(c["right"][own]) > WORD * np.maximum(high, 1.0)) & ~before(ends) & ~starts
        at = own[first]
        return {"page": batch["page"].take(pa.array(order[at])), "path": named(path[order[at]]), "line": pa.array(line[at]), "said": joined(text, apart_, first)}

    marks = tables(region, line, c, min_rows, min_columns)
    own = np.flatnonzero(marks["is_table"])
    if not len(own):
        return {}
    begins, group = marks["begins"], marks["group"]
    glued = ~begins & ~before(pc.ends_with(batch["words"], " ").to_numpy(zero_copy_only=False)[order])
    column = marks["column"][np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))]
    own = own[np.lexsort((column[own], line[own], region[own]))]
    region, group, line, column = region[own], group[own], line[own], column[own]
    new_table, new_row = fresh(region, group), fresh(region, group, line)
    first = new_row | fresh(column)
    cell = first | begins[own]
    table, row = running(new_table, fresh(page[order[own]])) - 1, running(new_row, new_table) - 1
    texts = joined(batch["words"].take(pa.array(order[own])), glued[own], cell)
    said = {"table": table, "row": row, "column": column} | {k: marks[k][own] for k in ("columns", "rows", "filled")}
    return {"page": batch["page"].take(pa.array(order[own[first]])), "cells": listed(texts, first[cell])} | {k: pa.array(v[first].astype(np.int64)) for k, v in said.items()}


def gathered(batches: Iterator[pa.RecordBatch], in_tables: bool, min_rows: int, min_columns: int, most: int) -> Iterator[pa.RecordBatch]:
    """The lines or cells of pages that may be held, and the pieces of the others as they are; what a row isn't, is null in it."""
    for batch, left_out in parts(batches, most):
        with np.errstate(all="ignore"):  # what is said of groups that have no such rows isn't read
            got = {k: batch[k] for k in batch.schema.names} if left_out else placed(batch, in_tables, min_rows, min_columns)
        if got:
            kinds = {k: batch[k].type for k in batch.schema.names if k != "path"} | {"path": pa.string()} | (CELLS if in_tables else LINES)
            rows = len(got["page"])
            yield pa.RecordBatch.from_arrays([got.get(k, pa.nulls(rows, kind)) for k, kind in kinds.items()], list(kinds))
