"""Column functions over texts and addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(c: Column) -> Column:
    """Runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " "))


def joined_key(*parts: Column) -> Column:
    """SHA-256 over parts with their bytes' number before each, so that no two lists of parts make one text; a null part is a mark of its own."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def glob_like(c: Column, pattern: str) -> Column:
    """Whole-value match in which * stands for any run of characters."""
    escaped = re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%")
    return c.like(escaped)


def path_glob(c: Column, pattern: str) -> Column:
    """* and ? within a segment, ** over segments, [..] a set of characters; a pattern without / looks at the last segment."""
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", pattern, re.S):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if len(part) > 1 else re.escape(part))
    return (c if "/" in pattern else F.element_at(F.split(c, "/"), -1)).rlike(f"^{out}$")


def host(url: Column) -> Column:
    """The lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def robots_pattern(pattern: str) -> str:
    """A regular expression for a robots.txt path pattern: * any run, $ the end."""
    ends = pattern.endswith("$")
    return "^" + re.escape(pattern.rstrip("$")).replace(r"\*", ".*") + ("$" if ends else "")


def note_score(tokens: list[str], subject: Column, text: Column, tags: Column) -> Column:
    """Sum over tokens of the best field: 5 a tag, 3 the subject, 2 the text; 0 unless every token occurs."""
    each = [F.when(F.array_contains(tags, t), 5).when(F.contains(F.lower(subject), F.lit(t)), 3).when(F.contains(F.lower(text), F.lit(t)), 2).otherwise(0) for t in tokens[:8]]
    return F.when(F.least(*each, F.lit(9)) > 0, sum(each, F.lit(0))).otherwise(0)


def in_minutes(minute: Column, start: int, end: int) -> Column:
    """A half-open window of minutes of the day that may go past midnight."""
    return ((minute >= start) & (minute < end)) if start <= end else ((minute >= start) | (minute < end))
