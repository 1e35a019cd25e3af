"""Rules of robots.txt files: lines into groups, and the group that holds for an agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rules(lines: DataFrame, site: str, line: str, raw: str, agent: str) -> DataFrame:
    """(site, pattern, allow) that hold for an agent, of robots.txt lines in order.

    Agents that follow one another share the rules after them; a rule ends the list, so the next agent begins another group, and groups that
    name the agent are one. They hold if they have a rule, even an empty disallow, else those of `*`. A comment goes from its mark on; what
    has no colon, or another field, is nothing and ends nothing. A rule without a leading / gets one; an empty one forbids nothing.
    """
    plain = F.trim(F.regexp_replace(F.split_part(raw, F.lit("#"), F.lit(1)), r"^\s+|\s+$", ""))
    said = lines.withColumn("_s", plain).where(F.contains("_s", F.lit(":"))).select(site, line, F.lower(F.trim(F.split_part("_s", F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace("_s", "^[^:]*:", "")).alias("value"))
    said = said.where(F.col("field").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy(site).orderBy(line)
    names = F.col("field") == "user-agent"
    begins = names & F.coalesce(F.lag("field").over(by) != "user-agent", F.lit(True))
    grouped = said.withColumn("_new", begins.cast("int")).withColumn("group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whose = F.max(F.when(names, F.when(F.lower("value") == agent.lower(), 2).when(F.col("value") == "*", 1).otherwise(0))).over(Window.partitionBy(site, "group"))
    ruled = grouped.withColumn("_whose", whose).where(~names & (F.col("_whose") > 0) & ((F.col("value") != "") | (F.col("field") == "disallow")))
    best = ruled.withColumn("_best", F.max("_whose").over(Window.partitionBy(site))).where("_whose = _best and value <> ''")
    return best.select(site, F.when(F.startswith("value", F.lit("/")), F.col("value")).otherwise(F.concat(F.lit("/"), "value")).alias("pattern"), (F.col("field") == "allow").alias("allow")).distinct()


def expression(pattern: Column) -> Column:
    """A regular expression for a pattern: * any run, a $ at its end the end, anything else itself."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    escaped = F.regexp_replace(body, r"[.^$+?()\[\]{}|\\]", r"\\$0")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def verdicts(paths: DataFrame, key: str, site: str, path: str, held: DataFrame) -> DataFrame:
    """(key, verdict): of the site's rules that match a path the longest decides, of equally long ones that which allows; no match allows. Joined by site."""
    met = paths.join(held.withColumn("_rx", expression(F.col("pattern"))), [site], "left").withColumn("_hit", F.coalesce(F.expr(f"{path} rlike _rx"), F.lit(False)))
    best = met.groupBy(key).agg(F.max_by(F.when(F.col("_hit"), F.col("allow")), F.when(F.col("_hit"), F.struct(F.length("pattern"), "allow"))).alias("a"))
    return best.select(key, F.when(F.coalesce("a", F.lit(True)), "allow").otherwise("disallow").alias("verdict"))
