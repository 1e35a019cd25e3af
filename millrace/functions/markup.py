"""Column functions over fragments of HTML: character references decoded, snippets cleaned, starting tags that look like a site's chrome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named references that are decoded; others stay as written.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "middot": "·", "bull": "•", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "laquo": "«", "raquo": "»", "times": "×", "divide": "÷", "plusmn": "±", "euro": "€", "pound": "£",
    "yen": "¥", "sect": "§", "para": "¶", "dagger": "†", "prime": "′", "shy": "",
}

# Parts of a class, id or role that mark a container as chrome, and whole words that do.
CHROME_PARTS = ["adsbygoogle", "advert", "banner", "breadcrumb", "consent", "cookie", "gdpr", "masthead", "navbar", "navigation", "newsletter", "paywall", "popup", "screen-reader", "sidebar", "side-bar", "site-footer", "site-header", "skip-link", "skip-to", "social", "sr-only", "subscribe", "toolbar"]
CHROME_WORDS = ["ad", "ads", "menu", "nav", "share", "sharing", "promo"]

SPACE = r"(?U)\s+"


def _character(code: Column) -> Column:
    """The character of a code point; null where there is none."""
    some = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(some, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """text with its numeric and NAMED references decoded, once; whatever else begins with & stays. Null gives null."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        number = F.when(decimal != "", decimal.try_cast("bigint")).when(hexed != "", F.conv(F.when(F.length(F.ltrim(hexed, F.lit("0"))) <= 6, hexed), 16, 10).try_cast("bigint"))
        named = F.try_element_at(names, F.regexp_extract(piece, r"^&([A-Za-z]+);$", 1))
        return F.when(F.startswith(piece, F.lit("&")), F.coalesce(_character(number), named, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,30}|#[xX][0-9a-fA-F]{1,29}|[A-Za-z]{1,31});|[^&]+|&"), F.lit(0))
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(F.transform(pieces, one), ""))


def collapsed(text: Column) -> Column:
    """text with each run of white space, of any script, as one space, and none at its ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def cleaned(snippet: Column) -> Column:
    """A search backend's snippet without tags, decoded, collapsed; a tag that doesn't end takes the rest."""
    return collapsed(decoded(F.replace(F.regexp_replace(snippet, r"(?s)<[^>]*(>|\z)", ""), F.lit(">"), F.lit(""))))


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute in the text after a tag's name, '' where it has none."""
    value = F.regexp_extract(attributes, rf"""(?i)(?:^|\s){name}\s*=\s*("[^"]*"?|'[^']*'?|\S+)""", 1)
    return F.regexp_replace(value, r"""^(["'])(.*?)\1?$""", "$2")


def is_chrome(attributes: Column) -> Column:
    """Whether class, id or role read like a site's chrome."""
    pattern = rf"(^|\s)({'|'.join(CHROME_WORDS)})(\s|$)|{'|'.join(CHROME_PARTS)}"
    said = [F.rlike(F.lower(attribute(attributes, a)), F.lit(pattern)) for a in ("class", "id", "role")]
    return said[0] | said[1] | said[2]
