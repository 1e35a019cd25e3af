"""Readable text of HTML pages by markup rules, as windows over the pages' tokens.

A page's tokens are rows that are shuffled once, by page; windows over them
pair tags, hide what is dropped, choose the region and set line breaks. Only
the text of a page is one row again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup

# Elements that go with all below them, those that never end, those whose content is no markup, containers that go if their attributes read like chrome.
DROPPED = ["applet", "audio", "button", "canvas", "dialog", "embed", "form", "iframe", "input", "map", "math", "menu", "meta", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "video", "aside", "footer", "nav"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style", "textarea", "title", "xmp"]
CONTAINERS = ["aside", "div", "footer", "form", "header", "nav", "ol", "section", "ul"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Elements that begin, and that end, with one or two line breaks.
BREAK_BEFORE = {2: [*HEADINGS, "pre"], 1: ["li", "br", "p", "div", "section", "article", "main", "header", "blockquote", "table", "tr", "ul", "ol", "dl", "dd", "dt", "figcaption", "address", "details", "summary", "hr"]}
BREAK_AFTER = {2: [*HEADINGS, "pre", "p", "blockquote", "table", "ul", "ol", "dl"], 1: ["div", "section", "article", "main", "header", "li", "tr", "dd", "dt", "figcaption", "address", "details", "summary"]}

TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s>/])[^>]*>.*?(?:</\1(?=[\s>])[^>]*>|\z)|<[!?][^>]*(?:>|\z)|</?[a-z0-9-]+[^>]*>|[^<]+|<"
LEAST = 200  # characters below which a main or article region counts only if the body has no more
SHARE = 8_000_000  # bytes of source that a task takes, about, or one longer page
BREAK = "\x01"  # stands before line breaks until the page is whole; one in a page is dropped


def _tokens(pages: DataFrame, html: str) -> DataFrame:
    """A row for each token of a page: its kind, name, attributes and source length.

    Tokens take many times the room of their source, which shuffles well packed, so beyond one share tasks are dealt by bytes of source and not left to be merged.
    """
    shares = -(-(pages.agg(F.sum(F.octet_length(html))).first()[0] or 0) // SHARE)
    dealt = [max(pages.sparkSession.sparkContext.defaultParallelism, shares)] if shares > 1 else []
    t = pages.withColumn("_row", F.monotonically_increasing_id())
    t = t.select(*[c for c in t.columns if c != html], F.posexplode_outer(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("_pos", "_tok")).repartition(*dealt, "_row")
    tag = F.regexp_extract("_tok", r"^</?([A-Za-z0-9-]+)", 1)
    t = t.withColumn("_name", F.lower(tag))
    raw = F.col("_name").isin(RAW) & ~F.startswith("_tok", F.lit("</"))
    kind = F.when(F.col("_tok").isNull() | F.rlike("_tok", F.lit("^<[!?]")), "none").when(F.col("_name") == "", "text").when(raw, "raw").when(F.startswith("_tok", F.lit("</")), "end").otherwise("start")
    t = t.withColumn("_kind", kind).withColumn("_attrs", F.when(F.col("_kind") == "start", F.expr("substring(_tok, length(_name) + 2, length(_tok) - length(_name) - 2)")))
    return t.withColumn("_open", (F.col("_kind") == "start") & ~F.endswith(F.rtrim("_attrs"), F.lit("/")) & ~F.col("_name").isin(VOID))


def _paired(t: DataFrame) -> DataFrame:
    """Tokens with `_closes`, where an open start tag's element ends (past all if it doesn't), and `_depth` of dropped elements around them.

    Start and end tags of one name at one level alternate, so a tag's fellow is its neighbour there.
    """
    step = F.when(F.col("_open"), 1).when(F.col("_kind") == "end", -1).otherwise(0)
    drops = F.col("_name").isin(DROPPED) | (F.col("_name").isin(CONTAINERS) & markup.is_chrome(F.col("_attrs")))
    t = t.withColumn("_drops", (F.col("_kind") == "start") & drops)
    level = F.sum(step).over(Window.partitionBy("_row", "_name").orderBy("_pos"))
    t = t.withColumn("_level", F.when(F.col("_open"), level).when(F.col("_kind") == "end", level + 1))
    fellow = Window.partitionBy("_row", "_name", "_level").orderBy("_pos")
    t = t.withColumn("_closes", F.when(F.col("_open"), F.coalesce(F.lead("_pos").over(fellow), F.lit(2**31 - 1)))).withColumn("_of", F.lag(F.col("_drops")).over(fellow))
    ends = (F.col("_kind") == "end") & F.coalesce("_of", F.lit(False))
    page = Window.partitionBy("_row").orderBy("_pos")
    t = t.withColumn("_depth", F.sum(F.when(F.col("_drops") & F.col("_open"), 1).when(ends, -1).otherwise(0)).over(page)).withColumn("_ends_drop", ends)
    return t.withColumn("_at", F.sum(F.length("_tok")).over(page))


def _regions(t: DataFrame) -> DataFrame:
    """Tokens inside the body and, once more, inside the longest main or article in it, with `_part` naming which."""
    page = Window.partitionBy("_row")
    # an element's source length, by the sum of lengths at its end tag
    fellow = Window.partitionBy("_row", "_name", "_level").orderBy("_pos")
    long = F.coalesce(F.lead("_at").over(fellow), F.max("_at").over(page)) - F.col("_at")
    place = F.struct(long.alias("long"), F.col("_pos").alias("first"), F.col("_closes").alias("last"), (F.col("_depth") - F.when(F.col("_drops"), 1).otherwise(0)).alias("depth"))
    t = t.withColumn("_place", F.when(F.col("_open") & F.col("_name").isin("body", "main", "article"), place))
    t = t.withColumn("_body", F.max(F.when(F.col("_name") == "body", F.col("_place"))).over(page))
    whole_page = F.struct(F.lit(0).cast("bigint").alias("long"), F.lit(-1).alias("first"), F.lit(2**31 - 1).alias("last"), F.lit(0).cast("bigint").alias("depth"))
    t = t.withColumn("_body", F.coalesce("_body", whole_page))
    inner = (F.col("_name") != "body") & (F.col("_pos") > F.col("_body.first")) & (F.col("_pos") < F.col("_body.last"))
    t = t.withColumn("_main", F.max(F.when(inner, F.col("_place"))).over(page))
    parts = F.array(F.struct(F.lit("body").alias("part"), F.col("_body").alias("in")), F.struct(F.lit("main").alias("part"), F.col("_main").alias("in")))
    t = t.withColumn("_p", F.explode(F.filter(parts, lambda p: p["in"].isNotNull()))).withColumn("_part", F.col("_p.part"))
    inside = (F.col("_pos") > F.col("_p.in.first")) & (F.col("_pos") < F.col("_p.in.last"))
    return t.where(inside).withColumn("_depth", F.col("_depth") - F.col("_p.in.depth"))


def readable(pages: DataFrame, html: str) -> DataFrame:
    """pages without `html`, with `text`: headings after #s, items after -, paragraphs apart by an empty line, white space collapsed but in `pre`.

    The text is that of the longest main or article, if it has LEAST characters
    or no fewer than the body; else the body's, or the whole page's without
    one. Comments, raw elements, DROPPED elements and containers whose class, id
    or role read like chrome are left out; an unclosed one hides the rest of
    the region. A tag that doesn't end is text. Null, empty and tag-only pages give ''; repeated rows stay.
    """
    keys = [c for c in pages.columns if c != html]
    t = _paired(_tokens(pages, html))
    names = t.groupBy("_row").agg(*[F.first(c).alias(c) for c in keys])
    t = _regions(t)
    own = F.when(F.col("_drops") & F.col("_open"), 1).otherwise(0)
    t = t.where((F.col("_depth") - own <= 0) & ~F.col("_ends_drop"))
    part = Window.partitionBy("_row", "_part").orderBy("_pos")
    pre = F.sum(F.when(F.col("_name") == "pre", F.when(F.col("_open"), 1).when(F.col("_kind") == "end", -1)).otherwise(0)).over(part) > 0
    start, end = (F.col("_kind") == "start") & ~F.col("_drops"), F.col("_kind") == "end"
    breaks = F.when((F.col("_kind") == "raw") | F.col("_drops"), 1)
    for side, table in ((start, BREAK_BEFORE), (end, BREAK_AFTER)):
        for n, of in table.items():
            breaks = breaks.when(side & F.col("_name").isin(of), n)
    said = markup.decoded(F.col("_tok"))
    t = t.withColumn("_pre", pre).withColumn("_breaks", breaks.otherwise(0)).withColumn("_said", F.when(F.col("_kind") == "text", F.replace(said, F.lit(BREAK), F.lit(""))))
    flat = markup.collapsed(F.col("_said"))
    marker = F.when(start & F.col("_name").isin(HEADINGS), F.repeat(F.lit("#"), F.substring("_name", 2, 1).cast("int"))).when(start & (F.col("_name") == "li"), "-")
    out = F.coalesce(marker, F.when(F.col("_pre"), F.when(F.col("_said") != "", F.col("_said"))).otherwise(F.when(flat != "", flat)))
    cell = F.col("_name").isin("td", "th") & F.col("_kind").isin("start", "end")
    loose = F.col("_said").isNotNull() & ~F.col("_pre")
    t = t.withColumn("_out", out).withColumn("_lead", cell | (loose & F.rlike("_said", F.lit(r"(?U)^\s")))).withColumn("_trail", marker.isNotNull() | (loose & F.rlike("_said", F.lit(r"(?U)\s$"))))
    # tokens up to and with the next that says something are its gap
    nth = F.count("_out").over(part) - F.when(F.col("_out").isNotNull(), 1).otherwise(0)
    gap = t.withColumn("_nth", nth).groupBy("_row", "_part", "_nth").agg(F.max("_breaks").alias("_breaks"), F.max("_lead").alias("_lead"), F.max("_out").alias("_out"), F.max(F.when(F.col("_out").isNotNull(), F.col("_trail"))).alias("_trail"))
    before = F.lag("_trail").over(Window.partitionBy("_row", "_part").orderBy("_nth"))
    apart = F.when(F.col("_breaks") > 0, F.concat(F.lit(BREAK), F.repeat(F.lit("\n"), F.col("_breaks")))).when(F.col("_lead") | F.coalesce(before, F.lit(False)), " ").otherwise("")
    pieces = gap.withColumn("_s", F.concat(apart, "_out")).where("_out is not null")
    texts = pieces.groupBy("_row", "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_s"))), lambda x: x["_s"]), "").alias("_t"))
    text = F.regexp_replace(F.regexp_replace("_t", rf"(?U)\s*{BREAK}", ""), r"(?U)^\s+|\s+$", "")
    both = texts.groupBy("_row").agg(F.max(F.when(F.col("_part") == "main", text)).alias("_main"), F.max(F.when(F.col("_part") == "body", text)).alias("_body"))
    chosen = F.when((F.length("_main") >= LEAST) | (F.length("_main") >= F.length("_body")), F.col("_main")).otherwise(F.coalesce("_body", "_main", F.lit("")))
    return names.join(both, "_row", "left").select(*keys, chosen.alias("text"))
