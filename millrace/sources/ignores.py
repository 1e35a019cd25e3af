"""Ignore rules that folders hold for what lies below them, over a table of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expression(rule: Column) -> Column:
    """A regular expression over the path below a rule's folder: * and ? within a segment, ** over segments, [..] a set, \\ makes the next character itself; a rule with a / before its end holds from its folder on, any other at every depth."""
    anchored = F.contains(F.regexp_replace(rule, "/$", ""), F.lit("/"))
    body = F.regexp_replace(rule, "^/|/$", "")
    said = F.regexp_replace(body, r"\\(.)|([.^$+(){}|])", r"\\$1$2")
    said = F.regexp_replace(said, r"\[!", "[^")
    for mark, stands in (("^[*][*]/", "(?:.*\u0001/)?"), ("/[*][*]/", "/(?:.*\u0001/)?"), ("/[*][*]$", "/.+"), (r"(?<![\\\u0001.)+])[*]+", "[^/]*"), (r"(?<![\\)])\?(?!:)", "[^/]")):
        said = F.regexp_replace(said, mark, stands)
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), F.replace(said, F.lit("\u0001"), F.lit("")), F.lit("$"))


def parsed(rules: DataFrame) -> DataFrame:
    """(folder, line, negated, only_folders, rx) of the lines that are rules: empty ones and those from # on are none, blanks at the end go unless a \\ is before them, ! lets in again."""
    plain = F.regexp_replace("rule", r"(?<!\\)[ \t\r]+$", "")
    said = rules.select("folder", "line", plain.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("#"))
    negated = F.col("rule").startswith("!")
    said = said.select("folder", "line", negated.alias("negated"), F.when(negated, F.substr("rule", F.lit(2))).otherwise(F.col("rule")).alias("rule")).where("rule not in ('', '/')")
    return said.select("folder", "line", "negated", F.endswith("rule", F.lit("/")).alias("only_folders"), expression(F.col("rule")).alias("rx"))


def kept(files: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """files that no rule ignores, of rules (folder, line, rule), the top folder being ''.

    For a file and each folder above it the last rule that matches in the deepest folder with one decides; what lies below an ignored folder is
    ignored, whatever rules let it in. Distinct folders and paths are judged once: each meets the rules of the folders above it in a join by
    folder, and a file its folders' verdicts in another. Rows without a path go; repeated rows stay.
    """
    paths = files.select(F.col(path).alias("_p")).where(F.col(path).isNotNull()).distinct()
    parts = F.split("_p", "/")
    above = lambda p, last: F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(F.split(p, "/"), F.lit(1), i), "/"))
    n = F.size(parts)
    named = paths.select(F.col("_p").alias("path"), F.lit(False).alias("is_folder"))
    folders = paths.where(n > 1).select(F.explode(above(F.col("_p"), n - 1)).alias("path"), F.lit(True).alias("is_folder")).distinct()
    every = named.unionByName(folders)
    m = F.size(F.split("path", "/"))
    at = every.select("path", "is_folder", F.explode(F.when(m > 1, F.concat(F.array(F.lit("")), above(F.col("path"), m - 1))).otherwise(F.array(F.lit("")))).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    met = at.join(parsed(rules), "folder").withColumn("_below", below).where((F.col("is_folder") | ~F.col("only_folders")) & F.expr("_below rlike rx"))
    last = met.groupBy("path", "is_folder").agg(F.max_by("negated", F.struct(F.length("folder"), "line")).alias("_in"))
    out = last.where("not _in").select(F.col("path").alias("_out"), "is_folder")
    lone = paths.select("_p", F.explode(F.concat(F.when(n > 1, F.transform(above(F.col("_p"), n - 1), lambda f: F.struct(f.alias("path"), F.lit(True).alias("is_folder")))).otherwise(F.array().cast("array<struct<path:string,is_folder:boolean>>")), F.array(F.struct(F.col("_p").alias("path"), F.lit(False).alias("is_folder"))))).alias("_s"))
    gone = lone.select("_p", F.col("_s.path").alias("_out"), F.col("_s.is_folder").alias("is_folder")).join(out, ["_out", "is_folder"], "left_semi").select("_p").distinct()
    return files.where(F.col(path).isNotNull()).join(gone, F.col(path) == F.col("_p"), "left_anti")
