"""Rules on requests: first match, missing fields, allow and deny lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(fields: dict[str, Column]) -> Column:
    """The names of fields that are null or blank, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull() | (F.trim(c) == ""), F.lit(n)) for n, c in fields.items()]))


def first_match(rules: list[tuple[str, str, Column]], default: str, absent: Column) -> tuple[Column, Column]:
    """(rule, decision): a request with missing fields is denied, else the first rule that holds decides, else the default."""
    rule = reduce(lambda out, r: out.when(r[2], r[0]), rules, F.when(F.size(absent) > 0, "policy.incomplete_request")).otherwise("default")
    decision = reduce(lambda out, r: out.when(r[2], r[1]), rules, F.when(F.size(absent) > 0, "deny")).otherwise(default)
    return rule, decision


def allowed(name: Column, allow: list[Column], deny: list[Column]) -> Column:
    """Deny beats allow; without allow patterns everything else is allowed."""
    any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    return F.when(any_of(deny), "denied").when(any_of(allow) if allow else F.lit(True), "allowed").otherwise("not listed")


def longest_match(paths: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, verdict): the longest pattern that matches decides, of equally long ones that which allows; no match allows.

    rules (pattern, allow, rx) are one site's, so they are few and broadcast.
    """
    met = paths.join(F.broadcast(rules), F.expr("path rlike rx"), "left")
    best = met.groupBy(key).agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("a"))
    return best.select(key, F.when(F.coalesce("a", F.lit(True)), "allow").otherwise("disallow").alias("verdict"))
