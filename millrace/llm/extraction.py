"""HTML extraction by a tree-structured graphical model.

The nodes are a page's block elements, each content or not. A node's own
potential is log-linear in its features: tag, length, links, punctuation, and the
words of class and id, each hashed to one of BUCKETS weights that training finds.
Parent and child share a potential by their two states.
Sum-product messages, upward from the leaves and downward from the root, give
each node's exact marginal; a block with a marginal over one half is content.

The potentials are trained by gradient ascent on the likelihood of labelled
pages, whose expectations are the same marginals. The labelled pages are made
here from a seed: layouts with menus, headers, asides, adverts, notices, forms,
comments and articles, where the maker knows which blocks are content. It leaves
a third of the blocks without a name and misnames some, so that the model also
learns to tell blocks by their structure.

Text of inline elements belongs to the block around them; a line break is white
space. Scripts, styles, heads, controls and comments are no nodes. Character
references are decoded, runs of white space become one space, blocks follow each
other in page order with one space between.

Null and empty html give an empty text. Repeated rows extract alike. Extra
columns stay, but for one that has the name of the new one.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_HINTS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")

# Element kinds.
SKIPPED = frozenset("script style head template noscript svg math iframe object canvas audio video textarea select button option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAGS = ("p", "div", "article", "main", "section", "body", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h", "table", "blockquote", "pre", "figure", "td")
BUCKETS = 1024
#: Names that the maker of labelled pages draws from; no feature knows them.
NAMES = {
    "good": "article content entry post story text main body prose paragraph page",
    "bad": "ad ads advert advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share social related recommended sidebar widget toolbar breadcrumb breadcrumbs pager pagination tags meta byline menu nav navbar navigation footer header masthead copyright legal login search form skip toc",
    "talk": "comment comments reply replies disqus discussion respond thread reactions feedback",
    "any": "box inner wrap row col block left right big dark item list panel group unit",
}


@cache
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Node:
    __slots__ = ("tag", "names", "parent", "runs", "links", "chars")

    def __init__(self, tag: str, names: set[str], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.runs, self.links, self.chars = [], 0, 0


@cache
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order (parents first) and the (node, text) runs in page order."""
    nodes, open_, runs = [Node("body", set(), -1)], [0], []
    links, text, at, unclosed = 0, [], 0, set()

    def flush() -> None:
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if run:
                runs.append((open_[-1], run))

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            n = nodes[open_[-1]]
            n.chars += len(piece)
            n.links += len(piece) if links else 0

    while m := _TOKEN.search(source, at):
        add(source[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in SKIPPED:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = None if tag in unclosed else _end(tag).search(source, at)
                if end is None:
                    unclosed.add(tag)  # nor is there an end further on
                at = end.end() if end else (len(source) if tag in ("script", "style") else at)
        elif tag in INLINE:
            links = max(0, links + (-1 if m[1] else 1)) if tag == "a" else links
            if tag == "br":
                text.append(" ")
        elif m[1]:
            flush()
            if any(nodes[i].tag == tag for i in open_[1:]):
                while nodes[open_.pop()].tag != tag:
                    pass
            links = 0
        elif tag == "hr" or tag in VOID:
            flush()
        elif tag in ("html", "body"):
            flush()
        else:
            flush()
            if tag in CLOSES_P and nodes[open_[-1]].tag == "p" or tag in ("li", "td", "tr", "dt", "dd") and nodes[open_[-1]].tag == tag:
                open_.pop()
            nodes.append(Node(tag, {w for v in _HINTS.findall(m[3]) for w in _WORDS.findall(v.lower())} if m[3] else set(), open_[-1]))
            open_.append(len(nodes) - 1)
            links = 0
    add(source[at:])
    flush()
    for i, run in runs:
        nodes[i].runs.append(run)
    return nodes, runs


DENSE = len(TAGS) + 9


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node, but for those of its names."""
    out = np.zeros((len(nodes), DENSE))
    t = len(TAGS)
    for i, n in enumerate(nodes):
        tag = "h" if len(n.tag) == 2 and n.tag[0] == "h" else n.tag
        if tag in TAGS:
            out[i, TAGS.index(tag)] = 1
        chars = sum(map(len, n.runs))
        share = n.links / n.chars if n.chars else 0.0
        marks = sum(len(_PUNCTUATION.findall(r)) for r in n.runs)
        out[i, t:] = (1, not n.names, chars == 0, min(chars, 400) / 400, chars > 80, share, share > 0.5, min(marks, 10) / 10, n.parent == 0)
    return out


def names(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(node, bucket) of each name of each node."""
    found = [(i, _bucket(w)) for i, n in enumerate(nodes) for w in n.names]
    return tuple(np.array(found, np.intp).reshape(-1, 2).T)


def odds(x: np.ndarray, named: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    return x @ w[:DENSE] + np.bincount(named[0], w[DENSE + named[1]], len(x))


def marginals(parents: list[int], own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content for each node, and the summed joint of parent and child states.

    own: log-odds of content; pair[parent state, child state]: log-potentials. Parents precede children.
    """
    n = len(parents)
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    up[:, 1] = own
    sent = np.zeros((n, 2))
    for i in range(n - 1, 0, -1):
        sent[i] = np.logaddexp(pair[:, 0] + up[i, 0], pair[:, 1] + up[i, 1])
        up[parents[i]] += sent[i]
    joint = np.zeros((2, 2))
    for i in range(1, n):
        above = down[parents[i]] + up[parents[i]] - sent[i]
        both = above[:, None] + pair
        down[i] = np.logaddexp(both[0], both[1])
        p = np.exp(both + up[i] - np.logaddexp.reduce((both + up[i]).ravel()))
        joint += p
    total = up + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


def labelled_pages(count: int = 240, seed: int = 11) -> list[tuple[str, set[str]]]:
    """Made pages with the set of their content words; every word is in one block only."""
    rng, serial = random.Random(seed), 0

    def words(n: int, stop: str = ".") -> str:
        nonlocal serial
        out = []
        for _ in range(n):
            serial += 1
            out.append(f"w{serial}" + (stop if rng.random() < 0.12 else ""))
        return " ".join(out) + stop

    def links(n: int) -> str:
        return "".join(f"<li><a href='/x'>{words(rng.randint(1, 3), '')}</a></li>" for _ in range(n))

    def named(kind: str) -> str:
        roll = rng.random()
        if roll < 0.3:
            return rng.choice(NAMES["any"].split())
        kind = rng.choice(sorted(NAMES)) if roll < 0.38 else kind
        return rng.choice(NAMES[kind].split()) + rng.choice(["", "-box", " inner", "-wrap", " " + rng.choice(NAMES["any"].split())])

    def junk() -> str:
        text = words(rng.randint(3, 45))
        return rng.choice([
            f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>", f"<div class='{named('bad')}'>{text}</div>", f"<div id='{named('bad')}'><p>{text}</p><p>{words(12)}</p></div>",
            f"<aside><h3>{words(3, '')}</h3><ul>{links(4)}</ul></aside>", f"<aside class='{named('bad')}'><p>{text}</p></aside>", f"<ul class='{named('bad')}'>{links(5)}</ul>", f"<form><p>{words(6)}</p><div>{words(3, '')}</div></form>",
            f"<section class='{named('talk')}'><h2>{words(2, '')}</h2><div class='{named('talk')}'><p>{text}</p></div><article class='{named('talk')}'><p>{words(25)}</p></article></section>", f"<div id='{named('talk')}'><ul><li><p>{text}</p></li><li>{words(14)}</li></ul></div>",
            f"<section><h2>{words(2, '')}</h2><ol class='{rng.choice(NAMES['any'].split())}'>" + "".join(f"<li><p>{words(rng.randint(2, 18))}</p></li>" for _ in range(rng.randint(2, 6))) + "</ol></section>",
            f"<div role='{rng.choice(['alert', 'banner', 'search', 'navigation'])}'>{text}</div>", f"<div><a href='/'>{words(4, '')}</a> <a href='/b'>{words(3, '')}</a></div>",
        ])

    pages = []
    for _ in range(count):
        kept: list[str] = []

        def good(n: int, stop: str = ".", kept: list[str] = kept) -> str:
            kept.append(words(n, stop))
            return kept[-1]

        blocks = [f"<h1>{good(rng.randint(2, 9), '')}</h1>"] * (rng.random() < 0.8)
        if blocks and rng.random() < 0.2:
            blocks = [f"<header>{blocks[0]}</header>"]
        for _ in range(rng.randint(1, 9)):
            blocks.append(rng.choices([f"<p>{good(rng.choice([1, 4, 20, 60, 120]))}</p>", f"<h2>{good(3, '')}</h2>", f"<blockquote><p>{good(15)}</p></blockquote>", f"<ul><li>{good(9)}</li><li>{good(5, '')}</li></ul>", f"<p>{good(8)} <a href='/y'>{good(2, '')}</a> {good(6)}</p>", f"<p><b>{good(5)}<br>", junk()], [10, 1, 1, 1, 2, 1, 1.5])[0])
        # texts that were made but not chosen are no content; a page's words tell which are
        body = "".join(blocks)
        open_, close = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f"<div class='{named('good')}'>", "</div>"), ("<div id='content'><div>", "</div></div>"), ("<div><div class='row'>", "</div></div>")])
        head = f"<header>{rng.choice(['<h1>' + words(3, '') + '</h1>', '<p>' + words(5) + '</p>', '<div>' + words(4, '') + '</div>'])}{junk() if rng.random() < 0.5 else ''}</header>" if rng.random() < 0.5 else ""
        foot = rng.choice([f"<footer>{words(8)}</footer>", f"<footer><p>&copy; {words(10)}</p><ul>{links(3)}</ul></footer>", f"<div class='footer'>{words(6)}</div>"])
        page = f"<html><head><title>{words(3)}</title></head><body>{head}{''.join(junk() for _ in range(rng.randint(1, 4)))}{open_}{body}{close}{''.join(junk() for _ in range(rng.randint(0, 3)))}{foot}</body></html>"
        pages.append((page, {w for t in kept for w in _made(t)}))
    return pages


def _made(text: str) -> list[str]:
    return re.findall(r"w\d+", text)


@cache
def model(steps: int = 60, rate: float = 0.25, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and the pairwise potentials, trained on the labelled pages."""
    data = []
    for page, content in labelled_pages():
        nodes, _ = parse(page)
        parents = [n.parent for n in nodes]
        y = np.array([any(w in content for r in n.runs for w in _made(r)) for n in nodes], dtype=float)
        for i in range(len(nodes) - 1, 0, -1):  # a block around content is content
            y[parents[i]] = max(y[parents[i]], y[i])
        data.append((parents, features(nodes), names(nodes), y))
    w, pair = np.zeros(DENSE + BUCKETS), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        g, h = np.zeros(len(w)), np.zeros((2, 2))
        for parents, x, named, y in data:
            p, joint = marginals(parents, odds(x, named, w), pair)
            g[:DENSE] += x.T @ (y - p)
            np.add.at(g, DENSE + named[1], (y - p)[named[0]])
            s = y[1:].astype(int)
            np.add.at(h, (y[parents[1:]].astype(int), s), 1.0)
            h -= joint
        full = np.append(g, h.ravel()) / len(data) - l2 * np.append(w, pair.ravel())
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full * full
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
    return w, pair


def extract(source: str | None, weights: tuple[np.ndarray, np.ndarray]) -> str:
    """The main text of a page."""
    if not source:
        return ""
    nodes, runs = parse(source)
    p, _ = marginals([n.parent for n in nodes], odds(features(nodes), names(nodes), weights[0]), weights[1])
    return " ".join(run for i, run in runs if p[i] > 0.5)


def with_text(pages: DataFrame) -> DataFrame:
    """pages with `text`, the main text of html."""
    weights = model()

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield sources.map(lambda s: extract(s, weights))

    return pages.withColumn("text", main_text("html"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
