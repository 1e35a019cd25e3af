"""Reading order and tables against a plain recursion over lists; ignore rules and windows of schedules at the edges."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import cron
from millrace.operators import pages, placed
from millrace.operators.layout import carried
from millrace.sources import ignores

RUN = "page long, id long, x double, y double, width double, height double, text string, path string"
BIG = (1 << 60) + 1


# the plain form: a run is (x, id, text, y, right, height)


def plain_lines(runs):
    out = []
    for r in sorted(runs, key=lambda r: (-r[3], r[0], r[1], r[2])):
        if out and abs(out[-1]["y"] - r[3]) <= 0.5 * max(out[-1]["h"], r[5]):
            out[-1]["h"] = max(out[-1]["h"], r[5])
            out[-1]["runs"].append(r)
        else:
            out.append({"y": r[3], "h": r[5], "runs": [r]})
    for one in out:
        one["runs"].sort(key=lambda r: r[:3])
    return out


def plain_cells(one):
    cells, end = [], None
    for x, _, text, _, right, _ in one["runs"]:
        step, at = (right - x) / len(text), 0
        found, start = [], None
        for i, c in enumerate(text + "  "):
            wide = text[i : i + 2] == "  " or (c == " " and i and text[i - 1 : i + 1] == "  ") or i >= len(text)
            if not wide and start is None:
                start = i
            if wide and start is not None:
                found.append((x + start * step, x + i * step, text[start:i]))
                start = None
        for at, (left, stop, words) in enumerate(found):
            if end is None or at or left - end > 0.75 * max(one["h"], 1):
                cells.append([left, stop, words])
            else:
                cells[-1][2] += ("" if cells[-1][2].endswith(" ") else " ") + words
                cells[-1][1] = stop
            end = stop
    return [(a, b, t.strip()) for a, b, t in cells]


def plain_tables(lines, min_rows=2, min_columns=2):
    groups = [[]]
    for i, one in enumerate(lines):
        far = i and lines[i - 1]["y"] - one["y"] > 2.5 * max(lines[i - 1]["h"], one["h"], 1)
        if far or len(plain_cells(one)) < 2:
            groups.append([])
        if len(plain_cells(one)) >= 2:
            groups[-1].append(one)
    for g in groups:
        if len(g) < max(2, min_rows):
            continue
        rows, anchors = [plain_cells(one) for one in g], []
        near = max(0.4 * max(1, *[one["h"] for one in g]), 4)
        for x in sorted(c[0] for r in rows for c in r):
            if not anchors or x - anchors[-1] > near:
                anchors.append(x)
        to = lambda where, x: min(range(len(where)), key=lambda i: (abs(x - where[i]), i))
        kept = [a for i, a in enumerate(anchors) if 2 * sum(any(to(anchors, c[0]) == i for c in r) for r in rows) >= len(rows)]
        if len(kept) < max(2, min_columns):
            continue
        grid, fills, n = {}, [], 0
        for i, r in enumerate(rows):
            for left, stop, text in r:
                k = to(kept, left)
                n += 1
                grid.setdefault((i, k), []).append(text)
                if k + 1 < len(kept):
                    fills.append(min(max(stop - kept[k], 0) / (kept[k + 1] - kept[k]), 2))
        if 5 * (n - len(grid)) > n or (fills and sorted(fills)[len(fills) // 2] > 0.8):
            continue
        yield len(rows), len(kept), {k: " ".join(v) for k, v in grid.items()}


def plain_gap(spans, least):
    best, reach = None, None
    for a, b in sorted(spans):
        if reach is not None and a - reach >= least and (best is None or a - reach >= best[0]):
            best = (a - reach, (a + reach) / 2)
        reach = b if reach is None else max(reach, b)
    return best and best[1]


def plain_order(runs, depth=0, path=""):
    if len(runs) >= 8 and depth < 6:
        high = sorted(r[5] for r in runs)[len(runs) // 2]
        at = plain_gap([(r[0], r[4]) for r in runs], max(0.03 * max(1, max(r[4] for r in runs) - min(r[0] for r in runs)), high))
        if at is not None:
            halves = [r for r in runs if r[4] <= at], [r for r in runs if r[4] > at]
            low, top = [min(r[3] for r in h) for h in halves], [max(r[3] + r[5] for r in h) for h in halves]
            shorter = min(t - b for t, b in zip(top, low, strict=True))
            whole = plain_lines(runs)
            table = len(whole) >= 3 and 10 * sum(t[0] for t in plain_tables(whole)) >= 6 * len(whole)
            if all(len(plain_lines(h)) >= 3 for h in halves) and (min(top) - max(low)) / shorter >= 0.5 and not table:
                return plain_order(halves[0], depth + 1, path + "a") + plain_order(halves[1], depth + 1, path + "b")
        at = plain_gap([(r[3], r[3] + r[5]) for r in runs], max(1.2 * high, 1))
        if at is not None:
            return plain_order([r for r in runs if r[3] >= at], depth + 1, path + "c") + plain_order([r for r in runs if r[3] < at], depth + 1, path + "d")
    return [(path, runs)]


def plain_text(one):
    out, end = "", None
    for x, _, text, _, right, _ in one["runs"]:
        if end is not None and x - end > 0.22 * max(one["h"], 1) and not out[-1].isspace() and not text[0].isspace():
            out += " "
        out, end = out + text, right
    return out.rstrip()


def made_pages():
    """Prose in columns, tables, headlines, single lines, and places at random on whole numbers, so that ties and touching runs occur."""
    rng, rows, i = random.Random(11), [], 0
    for page in range(36):
        kind, top = page % 4, 700
        for _ in range(rng.randint(1, 3)):
            for k in range(rng.randint(3, 7)):
                for c in range(rng.randint(2, 3) if kind == 1 else 2):
                    text = rng.choice(["alpha", "b", "gamma delta", "e  f", "total ", " x", "1,024"])
                    if kind == 3:
                        place = (rng.randint(0, 40) * 10, top - rng.randint(0, 12) * 9, rng.randint(1, 9) * 10, rng.choice([8, 9, 10, 14, 0]))
                    else:
                        place = (50 + (100 if kind == 1 else 260) * c, top - 14 * k + rng.randint(-2, 2), 5 * len(text) if kind == 1 else 240, 10)
                    rows.append((page if page else BIG, i, *map(float, place), text, "x"))
                    i += 1
            top -= 14 * 8 + rng.choice([0, 30])
    return rows


def test_pages_equal_a_plain_recursion(spark):
    rows = made_pages()
    df = spark.createDataFrame(rows, RUN).repartition(5)
    texts, cells = {}, {}
    for page in {r[0] for r in rows}:
        leaves = plain_order([(x, i, t, y, x + w, h or 1.0) for p, i, x, y, w, h, t, _ in rows if p == page])
        texts[page] = ("\n\n".join("\n".join(plain_text(one) for one in plain_lines(r)) for _, r in leaves), len({p[: i + 1] for p, _ in leaves for i, c in enumerate(p) if c == "a"}) + 1)
        found = [t for _, r in leaves for t in plain_tables(plain_lines(r))]
        for n, (nrows, ncols, grid) in enumerate(found):
            for (row, column), text in grid.items():
                cells[page, n, row, column] = (text, ncols, nrows, round(len(grid) / (ncols * nrows), 9))
    got = {r.page: (r.text, r.columns) for r in pages.page_texts(df).collect()}
    assert got == texts and len({c for _, c in texts.values()}) > 1
    mine = {(r.page, r.table, r.row, r.column): (r.text, r.columns, r.rows, round(r.occupancy, 9)) for r in pages.tables(df).collect()}
    assert mine == cells and len(cells) > 40


def test_pages_at_the_edges(spark):
    rows = [(None, 1, 0.0, 10.0, 20.0, 10.0, "lone", "p"), (1, None, 0.0, 10.0, 20.0, 10.0, "a", "p"), (1, None, 0.0, 10.0, 20.0, 10.0, "a", "p"), (2, 1, float("nan"), 1.0, 1.0, 1.0, "x", "p"), (3, 1, 1.0, 1.0, 1.0, 1.0, " \t", "p"), (4, 1, None, 1.0, 1.0, 1.0, "x", "p"), (5, 1, 1.0, 1.0, -4.0, -1.0, "thin", "p"), (5, 2, 1.0, 1.0, 1.0, 1.0, None, "p")]
    df = spark.createDataFrame(rows, RUN)
    assert {(r.page, r.text, r.truncated) for r in pages.page_texts(df, 4).collect()} == {(None, "lone", True), (1, "aa", False), (5, "thin", True)}
    assert pages.page_texts(df.limit(0)).count() == 0 and pages.tables(df).count() == 0


def test_pages_that_are_not_held_come_by_windows(spark, monkeypatch):
    df = spark.createDataFrame(made_pages()[::-1], RUN).where(f"page <= 14 or page = {BIG}").union(spark.createDataFrame([(1001, i, 1e307 * (i % 3), 9.0 * i, 1.0, 9.0, "far", "x") for i in range(9)], RUN))
    held = sorted(map(tuple, pages.page_texts(df).collect())), sorted(map(tuple, pages.tables(df).collect()))
    monkeypatch.setattr(pages, "MOST_HELD", 24)
    sizes = [r["count"] for r in pages.pieces(df).groupBy("page").count().collect()]
    assert min(sizes) <= 24 < max(sizes)
    assert held == (sorted(map(tuple, pages.page_texts(df).collect())), sorted(map(tuple, pages.tables(df).collect())))


def test_repeated_runs_keep_the_space_before_them(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, 0.0, 10.0, 20.0, 10.0, "a", "p")] + [(1, 2, 40.0, 10.0, 5.0, 10.0, "\x1dr", "p")] * 2, RUN)
    assert pages.page_texts(df).first()["text"] == "a \x1dr\x1dr"
    monkeypatch.setattr(pages, "MOST_HELD", 1)
    assert pages.page_texts(df).first()["text"] == "a \x1dr\x1dr"


def test_tables_of_pages_that_are_held_ask_for_no_window(spark):
    """Each level of windows sorts all rows some ten times anew."""
    got = pages.tables(spark.createDataFrame(made_pages(), RUN))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() > 40


def test_parts_of_a_task_hold_whole_pages():
    pages_of = [None] * 3 + [1] * 9 + [2] * 2 + [3] * 30 + [BIG] + [BIG + 1] * 6 + [BIG + 2] * 12
    rows = pa.RecordBatch.from_pydict({"page": pa.array(pages_of, pa.int64()), **{k: np.arange(len(pages_of), dtype=float) for k in ("x", "y", "right", "height", "left", "end")}})
    for size in (1, 2, 5, 100):
        got = [(part["page"].to_pylist(), out) for part, out in placed.parts(iter([rows.slice(i, size) for i in range(0, len(pages_of), size)]), 10)]
        assert [p for part, out in got if not out for p in part] == [p for p in pages_of if pages_of.count(p) <= 10]
        assert [p for part, out in got if out for p in part] == [3] * 30 + [BIG + 2] * 12
        assert all(part.count(p) == pages_of.count(p) for part, out in got if not out for p in set(part))


def test_steps_read_only_what_they_need(spark):
    df = spark.createDataFrame([(1, 2, "b", 5.0), (1, 1, "a", None), (None, 1, "c", 1.0), (2, 3, None, 2.0)], "k long, n int, said string, v double")
    got = carried(df, "k", ["n"], lambda s, row: ((s or 0) + (row[0] or 0), (len(row), (s or 0) + (row[0] or 0))), ["n", "said", "v"], "k long, n long, said string, v double, width long, sum double", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, "a", None, 1, 0.0), (1, 2, "b", 5.0, 1, 5.0), (2, 3, None, 2.0, 1, 2.0), (None, 1, "c", 1.0, 1, 1.0)]


def test_columns_of_runs_are_worked_out_once(spark):
    """A filter over made columns makes them again for each of its parts."""
    runs = spark.createDataFrame([(1, 1, 2.0, "a"), (1, 2, 3.0, ""), (1, 3, 3.0, None)], "page long, id long, at double, word string")
    text = F.concat_ws("-", "word", F.lit("x"))
    made = runs.select("page", "id", F.col("at").alias("x"), F.col("at").alias("y"), (5.0 * F.length(text)).alias("width"), F.lit(9.0).alias("height"), text.alias("text"))
    got = pages.pieces(made)
    assert not any("Filter" in line and "concat_ws" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert sorted((r.id, r.words, r.left, r.end) for r in got.collect()) == [(1, "a-x", 2.0, 17.0), (2, "-x", 3.0, 13.0), (3, "x", 3.0, 8.0)]
    assert pages.pieces(made.withColumn("text", F.when(F.col("id") == 1, "").when(F.col("id") == 2, " "))).count() == 0


# ignore rules


def left_over(spark, paths, rules):
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, folder int")
    return sorted(r.path for r in ignores.kept(files, "path", spark.createDataFrame(rules, "folder string, line int, rule string")).collect())


def test_ignore_rules(spark):
    assert left_over(spark, ["src/kept.rs", "src/ignored.rs", "built/artifact.rs", "src/built", None], [("", 1, "ignored.rs"), ("", 2, "built/")]) == ["src/built", "src/kept.rs"]
    # below an ignored folder nothing comes back; below a folder whose files alone are ignored it does
    assert left_over(spark, ["a/x/k.c", "b/x/k.c", "b/x/n.c"], [("", 1, "/a/x"), ("", 2, "!k.c"), ("b", 1, "x/*"), ("b", 2, "!x/k.c")]) == ["b/x/k.c"]
    # the deepest folder with a match decides, of its lines the last
    assert left_over(spark, ["d/a.log", "d/e/a.log", "a.log"], [("", 1, "*.log"), ("d", 1, "!*.log"), ("d/e", 1, "!a.log"), ("d/e", 2, "a*")]) == ["d/a.log"]
    # ** over folders, ? and sets within a segment, marks of patterns as themselves, comments, blanks at the end
    assert left_over(spark, ["p/q/r/z.o", "p/z.o", "p/zz.o", "t/u/v", "t/u", "a+b.c", "aab.c", "#n", "w1", "w2", "e "], [("", 1, "p/**/z.o"), ("", 2, "t/**"), ("", 3, "a+b.c"), ("", 4, "#n"), ("", 5, "w[!2]  "), ("", 6, ""), ("", 7, "!")]) == ["#n", "aab.c", "e ", "p/zz.o", "w2"]
    assert left_over(spark, ["#n", "!m", "x?y", "xzy", "a/b"], [("", 1, "\\#n"), ("", 2, "\\!m"), ("", 3, "x\\?y"), ("", 4, "/"), ("", 5, "a/?")]) == ["xzy"]
    assert left_over(spark, ["a", "a"], [("b", 1, "a"), ("", 2, None)]) == ["a", "a"]
    assert left_over(spark, [], [("", 1, "a")]) == [] == left_over(spark, ["a"], [("", 1, "*")])


# first runs inside a window


def first(spark, at, *rest):
    moment = None if at is None else datetime.fromisoformat(at)
    df = spark.createDataFrame([(moment,)], "at timestamp_ntz")
    got = cron.first_inside(df, "at", *rest).first()["next_run"]
    return got and got.isoformat(" ", "minutes")


def test_first_run_inside_a_window(spark):
    assert first(spark, "2026-03-01 02:59", "0 3 * * *") == "2026-03-01 03:00"
    assert first(spark, "2026-03-01 03:00", "0 3 * * *") == "2026-03-02 03:00"
    assert first(spark, "2026-03-01 12:00", "0 * * * *", "UTC", (22 * 60, 60)) == "2026-03-01 22:00"
    assert first(spark, "2026-03-01 23:30", "0 * * * *", "UTC", (22 * 60, 60)) == "2026-03-02 00:00"
    assert first(spark, "2026-03-01 12:00", "0 12 * * *", "UTC", (13 * 60, 14 * 60)) is None
    assert first(spark, "2026-03-01 12:00", "0 0 30 2 *") is None and first(spark, None, "0 3 * * *") is None
    assert first(spark, "2026-03-01 00:00", "0 0 29 2 *") == "2028-02-29 00:00"
    # New York skips 02:30 on 8 March 2026 and shows 01:30 twice on 1 November
    assert first(spark, "2026-03-08 06:00", "30 2 * * *", "America/New_York") == "2026-03-09 06:30"
    assert first(spark, "2026-11-01 04:00", "30 1 * * *", "America/New_York") == "2026-11-01 05:30"
    assert first(spark, "2026-11-01 05:30", "30 1 * * *", "America/New_York") == "2026-11-02 06:30"
    # the window is read on the zone's clock
    assert first(spark, "2026-07-01 00:00", "0 * * * *", "America/New_York", (9 * 60, 10 * 60)) == "2026-07-01 13:00"
