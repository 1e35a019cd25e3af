"""Queries over placed runs of text (their rows are held against a plain recursion in the tests), ignore rules of folders, first runs inside a window."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import cron
from .operators import pages
from .queries import query
from .sources import ignores
from .sources.tables import table


def _runs(spark, sf):
    """The line items of a part as the runs of its page: two columns of prose, a table of three columns, or a headline above prose, by the part."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
    d = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order)) - 1)
    kind, k = F.col("l_partkey") % 3, F.col("k")
    column = F.when(kind == 1, k % 3).otherwise(k % 2)
    row = F.when(kind == 1, F.floor(k / 3)).otherwise(F.floor(k / 2))
    text = F.when(kind == 1, F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.concat_ws(" ", F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("of"), F.col("l_quantity").cast("int").cast("string")))
    head = (kind == 2) & (k < 2)
    y = 700.0 - 14 * row - F.when((kind == 2) & ~head, 30).otherwise(0) + (F.col("l_suppkey") % 3)
    width = F.when(kind == 1, 5.0 * F.length(text)).otherwise(235.0 - F.col("l_orderkey") % 7)
    return d.select(F.col("l_partkey").alias("page"), k.cast("long").alias("id"), (50.0 + F.when(kind == 1, 100).otherwise(260) * column).alias("x"), y.alias("y"), width.alias("width"), (9.0 + F.col("l_linenumber") % 3).alias("height"), text.alias("text"))


@query()
def page_reading_order(spark, sf):
    return pages.page_texts(_runs(spark, sf))


@query()
def page_tables(spark, sf):
    got = pages.tables(_runs(spark, sf))
    return got.withColumn("occupancy", F.round("occupancy", 4))


_PATHS = """p AS (SELECT o_orderkey AS id, 'src' || (o_custkey % 7) || '/' || CASE o_orderkey % 4 WHEN 0 THEN 'build/' WHEN 1 THEN 'lib/deep/' WHEN 2 THEN '' ELSE 'lib/' END || lower(o_orderstatus) || (o_orderkey % 50) || CASE o_orderkey % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.rs' ELSE '.tmp' END AS path FROM orders)"""
#: (folder, line, rule) of ignore files.
RULES = [("", 1, "# built files"), ("", 2, "*.tmp"), ("", 3, "build/"), ("", 4, "!f1?.tmp"), ("src1", 1, "!*.tmp"), ("src1", 2, "/lib/*.log"), ("src2", 1, "lib/deep"), ("src2", 2, "!lib/deep/o1.rs"), ("src3/lib", 1, "deep/*"), ("src3/lib", 2, "!deep/*.rs"), ("src4", 1, "**/o*"), ("src5", 1, "!build/")]


@query(f"""WITH {_PATHS}, f AS (SELECT *, regexp_extract(path, '[^/]+$') AS name, split_part(path, '/', 1) AS top, path LIKE '%/build/%' AS built, path LIKE '%/lib/deep/%' AS deep FROM p)
  SELECT id, path FROM f WHERE NOT CASE
    WHEN built AND top <> 'src5' THEN true
    WHEN top = 'src2' AND deep THEN true
    WHEN top = 'src3' AND deep THEN NOT name LIKE '%.rs'
    WHEN top = 'src4' AND name LIKE 'o%' THEN true
    WHEN top = 'src1' AND name LIKE '%.tmp' THEN false
    WHEN top = 'src1' AND path LIKE 'src1/lib/%.log' AND NOT deep THEN true
    WHEN regexp_matches(name, '^f1.\\.tmp$') THEN false
    ELSE name LIKE '%.tmp' END""")
def files_not_ignored(spark, sf):
    """Order keys as files in folders, under ignore files in some of them."""
    k = F.col("o_orderkey")
    folder = F.when(k % 4 == 0, "build/").when(k % 4 == 1, "lib/deep/").when(k % 4 == 2, "").otherwise("lib/")
    ending = F.when(k % 3 == 0, ".log").when(k % 3 == 1, ".rs").otherwise(".tmp")
    path = F.concat(F.lit("src"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), folder, F.lower("o_orderstatus"), (k % 50).cast("string"), ending)
    files = table(spark, sf, "orders").select(k.alias("id"), path.alias("path"))
    return ignores.kept(files, "path", spark.createDataFrame(RULES, "folder string, line int, rule string"))


@query("""SELECT event_id, (SELECT min(m) FROM (SELECT d + to_minutes(t) AS m FROM (SELECT date_trunc('day', e.ts) + to_days(i::INTEGER) AS d FROM range(0, 8) r(i)), (SELECT unnest([h * 60 + 30 FOR h IN range(0, 24, 5)])::INTEGER AS t) WHERE dayofweek(d) BETWEEN 1 AND 5 AND (t >= 1200 OR t < 360)) WHERE m > date_trunc('minute', e.ts))::TIMESTAMP AS next_run FROM events e""")
def first_run_inside(spark, sf):
    """The half hours of every fifth hour of working days, from eight in the evening until six."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return cron.first_inside(e, "ts", "30 */5 * * mon-fri", "UTC", (20 * 60, 6 * 60)).drop("ts")
