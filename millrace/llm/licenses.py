"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line of the document with as many of the words after it as the
longest template has but one, so a template that begins in a line is in its
block however it is wrapped. A template is a set of words. A block meets a
template if it has at least CONTAINMENT of the template's words. A template
that is a base phrase is found across lines as that phrase; as a template it is
looked for in the line alone. Words are ordered by how many lines of all
documents have them, rarest first; any order gives the same result. Words of no
template come before all others, so they never stand in the way. Filters:

- prefix: of a template's words, those that come first, as many as may be missed
  and one more; a block without any of them can't meet the template;
- length: a block with fewer template words than are needed can't;
- position: if the first word that both have is at position i of the template
  and j of the block, they share at most min(size - i, size - j) words.

What is left is verified on whole sets. Templates are a parameter, a mapping or
a table of (label, text), and become literals of the plan, so blocks never leave
their row: nothing is shuffled but the word counts, summed before their shuffle.

Base labels are phrases: places where their words stand consecutively.

Nulls count as empty texts (no words, null first and last word, no labels,
score 0). Repeated rows get equal results. Extra columns are ignored. Where
counts tie, words are ordered by code point.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8

# Base phrases and license templates.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "cc0 1 0 universal public domain dedication",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _literal(items) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _strong(templates: dict[str, str]) -> str:
    """A pattern that finds a word of any template; a line without one meets none."""
    found = sorted({w for t in templates.values() for w in t.split()})
    return r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(found) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"


def _block(more: int) -> str:
    """A pattern that finds each line with up to `more` words after it as group 1; it is empty for lines without words."""
    letter, other = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    return rf"(?md)^(?=([\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*+{letter}[^\n]*+(?:{other}++{letter}++){{0,{more}}}+|))"


def frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """How many lines of all documents have each template word; as many rows as there are template words."""
    known = sorted({w for t in templates.values() for w in t.split()})
    lines = docs.select(F.explode(F.split(lowered(F.col("text")), "\n")).alias("line")).where(F.col("line").rlike(_strong(templates)))
    counted = lines.select(F.explode(F.array_intersect(words(F.col("line")), _literal(known))).alias("word")).groupBy("word").count()
    return dict.fromkeys(known, 0) | {r["word"]: r["count"] for r in counted.collect()}


def _needed(size: int, containment: float) -> int:
    return max(1, -int(-size * containment // 1))


def scanned(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs with `words`, `places` (start, label of base phrases) and `blocks` (line, template, containment).

    Templates are a parameter: a table of them has to be one that a plan can hold. Columns of docs with these names are replaced.
    """
    if isinstance(templates, DataFrame):
        templates = {r["label"]: r["text"] for r in templates.select("label", lowered(F.col("text")).alias("text")).collect()}
    counts = frequencies(docs, templates)
    plan = []
    for label, text in sorted(templates.items()):
        ordered = sorted(set(text.split()), key=lambda w: (counts[w], w))
        need = _needed(len(ordered), containment)
        plan.append((label, ordered, need, ordered[: len(ordered) - need + 1]))
    starters = sorted({w for _, _, _, prefix in plan for w in prefix})
    prefix_pattern = _strong(dict(enumerate(starters)))
    ranked = _literal(sorted(counts, key=lambda w: (counts[w], w)))

    def blocks(block: Column, number: Column) -> Column:
        own = F.array_intersect(ranked, words(block))  # the block's template words in the global order
        line = F.array_intersect(ranked, words(F.substring_index(block, "\n", 1)))

        def met(both: Column) -> Column:
            def one(label: str, ordered: list[str], need: int, prefix: list[str]) -> Column:
                mine = both["line"] if templates[label] in PHRASES.values() else both["own"]
                shared = F.array_intersect(_literal(prefix), mine)
                i, j = F.array_position(_literal(prefix), F.get(shared, F.lit(0))), F.array_position(mine, F.get(shared, F.lit(0)))
                passes = (F.size(mine) >= need) & (F.size(shared) > 0) & (F.least(len(ordered) - i, F.size(mine) - j) + 1 >= need)
                held = F.size(F.array_intersect(mine, _literal(ordered)))
                return F.when(passes & (held >= need), F.struct(number.cast("int").alias("line"), F.lit(label).alias("template"), (held / len(ordered)).alias("containment")))

            return F.array_compact(F.array(*[one(*p) for p in plan]))

        return F.element_at(F.transform(F.array(F.struct(own.alias("own"), line.alias("line"))), met), 1)

    low = free_name(docs, "_low")
    base = docs.withColumn(low, lowered(F.col("text"))).withColumn("words", words(F.col(low)))
    # blocks that hold a word of some template's prefix; the others can't meet any
    longest = max((len(t.split()) for t in templates.values()), default=1)
    numbered = F.transform(F.regexp_extract_all(low, F.lit(_block(longest - 1)), F.lit(1)), lambda block, i: F.struct(i.alias("i"), block.alias("block")))
    likely = F.filter(numbered, lambda x: x["block"].rlike(prefix_pattern))
    found = F.flatten(F.transform(likely, lambda x: blocks(x["block"], x["i"])))
    none = F.array().cast("array<struct<line:int,template:string,containment:double>>")
    base = base.withColumn("blocks", F.when(F.col(low).rlike(prefix_pattern), found).otherwise(none))

    def at(label: str, phrase: str) -> Column:
        parts = phrase.split()
        begins = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: F.get(F.col("words"), i - 1) == parts[0])
        rest = lambda i: F.slice(F.col("words"), i, len(parts)) == _literal(parts)
        return F.transform(F.filter(begins, rest), lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    empty = F.array().cast("array<struct<start:bigint,label:string>>")
    rough = "|".join(f"{p.split()[0]}[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+{p.split()[1]}" for p in PHRASES.values())
    places = F.concat(*[at(label, phrase) for label, phrase in sorted(PHRASES.items())])
    return base.withColumn("places", F.when(F.col(low).rlike(rough), places).otherwise(empty)).drop(low)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    found = F.transform("blocks", lambda b: b["template"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return s.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, found)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
