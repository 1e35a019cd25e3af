"""Texts for people and machines: sanitising, redaction, snippets, headings, sentences, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(text: Column, most: int) -> Column:
    """Line feeds alone, other control characters but tabs as spaces, no white space at line ends or around, at most so many characters."""
    one = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B-\x1F\x7F]", " ")
    return F.left(F.regexp_replace(F.regexp_replace(one, r"[ \t]+(?=\n|$)", ""), r"^[ \t\n]+|[ \t\n]+$", ""), F.lit(most))


def tag(text: Column, most: int) -> Column:
    """A tag in lower-case letters, digits and -_./; null if nothing is left."""
    out = F.substring(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\-_./]", ""), 1, most)
    return F.when(out != "", out)


def tag_set(tags: Column, most: int, long: int = 32) -> Column:
    """Normalised tags, each once, in order, at most so many."""
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.transform(tags, lambda t: tag(t, long))))), 1, most)


def truncated(text: Column, most: int) -> Column:
    """(text, cut): at most so many characters, back to the last blank line if that keeps three quarters of them."""
    head = F.left(text, F.lit(most))
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    back = (F.instr(head, "\n\n") > 0) & (at * 4 >= most * 3)
    kept = F.rtrim(F.when(back, F.left(head, at)).otherwise(head))
    return F.when(F.length(text) > most, F.struct(kept.alias("text"), F.lit(True).alias("cut"))).otherwise(F.struct(text.alias("text"), F.lit(False).alias("cut")))


def redacted_url(url: Column) -> Column:
    """A password in an address as ***."""
    return F.regexp_replace(url, r"(://[^:/@\s]+:)[^@\s]+@", "$1***@")


def redacted_arguments(arguments: Column, secret) -> Column:
    """Values of secret flags as ***, whether they follow an equals sign or come as the next argument."""
    return F.transform(arguments, lambda x, i: F.when((i > 0) & secret(F.get(arguments, i - 1)) & ~F.contains(F.get(arguments, i - 1), F.lit("=")), "***").when(F.contains(x, F.lit("=")) & secret(F.split_part(x, F.lit("="), F.lit(1))), F.concat(F.split_part(x, F.lit("="), F.lit(1)), F.lit("=***"))).otherwise(x))


def snippet(text: Column, at: Column, width: int) -> Column:
    """A window of the text with a third of its width before the place, and marks where it was cut."""
    start = F.greatest(at - width // 3, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, F.lit(width)), F.when(F.length(text) >= start + width, "…").otherwise(""))


def heading(line: Column) -> Column:
    """(level, title) of a heading that begins with #; null for other lines and empty titles."""
    marks = F.regexp_extract(line, r"^ {0,3}(#{1,6})[ \t]", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract(line, r"^ {0,3}#{1,6}[ \t](.*)$", 1), r"[ \t]+#+[ \t]*$|^#+$", ""))
    return F.when((marks != "") & (title != ""), F.struct(F.length(marks).alias("level"), title.alias("title")))


def sentences(text: Column) -> Column:
    """Sentences end after . ! ? or a line feed that white space follows; white space stays with the sentence before."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s).+?(?:[.!?\n]\s+|\z)"), F.lit(0)), lambda s: s != "")


def without_tags(html: Column) -> Column:
    """Markup dropped; an unclosed < drops the rest."""
    return F.regexp_replace(html, r"(?s)<[^>]*(>|\z)", "")


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def for_repeats(text: Column) -> Column:
    """Letters, digits and single spaces in lower case, to tell whether a text is said again."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")), r"\s+", " "))


def listed(items: Column, most: int) -> Column:
    """At most so many items, and how many more there are."""
    more = F.size(items) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.array_join(items, ", "))


def percent_encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def page_numbers(selection: Column, pages: Column | int = 10_000) -> Column:
    """Distinct numbers of a selection such as 1-3,7, in order, of a document of so many pages; what is beyond, or no number, is left out."""
    most = pages if isinstance(pages, Column) else F.lit(pages)
    parts = F.filter(F.split(F.regexp_replace(selection, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    spans = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).try_cast("bigint").alias("a"), F.split_part(p, F.lit("-"), F.lit(-1)).try_cast("bigint").alias("b")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: (s["a"] <= s["b"]) & (s["a"] <= most)), lambda s: F.sequence(s["a"].cast("int"), F.least(s["b"], most).cast("int"))))))
