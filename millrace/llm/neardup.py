"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of four words; with fewer words
the whole sequence is its one shingle. A sketch has T bins. In round i < T every
shingle falls into one random bin, in round T + j all fall into bin j; a bin
keeps the least (round, hash). The last T rounds guarantee that every bin
fills; usually two or three rounds do. Bins of two sets agree with a
probability equal to their similarity, with the concentration bounds of T
independent samples. Bands of R bins are the keys of candidate buckets: at
similarity 0.8 a pair shares none of the bands with a probability of 2e-6.

Documents with equal sets are one class, represented by the smallest id, so a
group of copies costs one row each. Links are only made by comparing whole
shingle sets, in three looks that get smaller; links within a component would
change nothing and are not looked for.

1. Every bucket has a hub: the member that shares most buckets, as the text
   from which near copies were made shares more with each than they do with one
   another. A member is compared with the most shared of its buckets' hubs.
2. Members are compared with the other hubs of their buckets, unless they are in
   one component with them by now.
3. Where a bucket still holds several components, its members compare sketches.
   Those with a partner in another component whose bins agree often enough (a
   tail of 1e-6 at similarity 0.8) meet with their whole sets, which are counted
   against one another through an index of shingles, and each place gives no
   more links than it takes to join components: fewer than it has members.

Looks 1 and 2 give at most a pair a bucket row. The bands of a large group of
pairwise unlinked members remain the costly case: look 3 deals its members out
by blocks of SKETCHES, so each is sent to as many places as the bucket has blocks.

Nulls, empty and blank texts have no shingles and link with nothing. A null
doc_id links with nothing and is kept. The stage takes shingles of five words;
four are op9_neardup's own. Rows that repeat a doc_id are one node of the graph
with several sets, each with the set size of its own text; the stage keeps one
row of such an id. Extra columns are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, written

WORDS, STAGE_WORDS, PERCENT = 4, 5, 80
BINS, BAND_ROWS = 392, 7
#: Bins that must agree, of BINS, for a pair to be verified in the third look: five deviations under 0.8.
AGREE = 274
#: Members of a block that compare sketches, shingles of a block that meet with whole sets, and members that meet one copy of a hub's set.
SKETCHES, SHINGLES, MEMBERS = 4096, 1_000_000, 1024

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _M + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of hashes: for each bin the least round and hash.

    A key's upper bits hold every round up to 2 * bins - 1; an unfilled bin's, all ones, are more than any round.
    """
    best = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    at, step = 0, max(1, 512 // len(h))
    bits = (2 * bins).bit_length()
    low, up = np.uint64(bits), np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        while at < 2 * bins:
            rounds = np.arange(at, min(2 * bins, at + step), dtype=np.uint64)[:, None]
            u = _mix(_mix(h[None, :] ^ (rounds + np.uint64(1)) * _M))
            where = np.where(rounds < bins, u % np.uint64(bins), rounds - np.uint64(bins) if at + step > bins else 0)
            np.minimum.at(best, where.astype(np.intp).ravel(), ((rounds << up) | (u >> low)).ravel())
            at += step
            if (best >> up).max() < min(at, 2 * bins):
                break
    return best


def bands(s: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of a sketch."""
    s = s[: len(s) // rows * rows].reshape(-1, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, len(s) + 1, dtype=np.uint64)
        for i in range(rows):
            key = _mix(key * _M + s[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_key, tag, bands) of each row; the last three are null for an empty set.

    tag holds the set's size above 32 bits of its hash, so (doc_id, tag) tells
    apart the sets of an id.
    """

    @F.pandas_udf("struct<n_shingles:long,set_key:binary,tag:long,bands:array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingles(t, words)
                if len(h):
                    key = xxhash.xxh128_digest(h.tobytes())
                    rows.append((len(h), key, _tag(len(h), key), bands(sketch(h))))
                else:
                    rows.append((0, None, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "tag", "bands"], dtype=object).astype({"n_shingles": "int64", "tag": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), run("text").alias("s")).select("doc_id", "s.*")


def _tag(n: int, key: bytes) -> int:
    return n << 32 | int.from_bytes(key[:4], "little")


def _size(tag: str) -> Column:
    return F.shiftright(F.col(tag), 32)


def _fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def whole_sets(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, tag, hashes, low, bands): the sets of the documents whose ids are in nodes, with the lowest bytes of their sketches' bins and their keys.

    A set that an id repeats is given once for each run of its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = None, set()
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["node"], pdf["text"], strict=True):
                if i != at:
                    at, seen = i, set()
                if len(h := shingles(t, words)):
                    raw = h.tobytes()
                    if (tag := _tag(len(h), xxhash.xxh128_digest(raw))) not in seen:
                        seen.add(tag)
                        k = sketch(h)
                        rows.append((i, tag, raw, k.astype(np.uint8).tobytes(), bands(k).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "tag", "hashes", "low", "bands"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.hint("merge"), "node")
    return texts.mapInPandas(run, "node long, tag long, hashes binary, low binary, bands binary")


def _linked(both: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    return (both > 0) & (100 * both >= PERCENT * (n + sizes - both))


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of the pairs (hub, hub_tag, node, tag) whose full sets meet the threshold.

    Nodes are dealt in parts of some MEMBERS with their hub, so a hub with many
    nodes is in many places. A place holds the hub's set, and nodes stream by.
    """
    parts = pairs.groupBy("hub", "hub_tag").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", "tag"), "parts").cast("int").alias("part")
    dealt = scratch.written(pairs.join(parts, ["hub", "hub_tag"]).select("hub", "hub_tag", "node", "tag", part), "dealt")
    own = dealt.select(F.col("hub").alias("node"), F.col("hub_tag").alias("tag"), "hub", "hub_tag", "part", F.lit(0).alias("turn")).distinct()
    needs = own.union(dealt.select("node", "tag", "hub", "hub_tag", "part", F.lit(1).alias("turn")))
    rows = needs.join(sets.select("node", "tag", "hashes"), ["node", "tag"]).select("hub", "hub_tag", "part", "turn", "node", "hashes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = None, np.empty(0, np.uint64)
        for pdf in batches:
            found = []
            for hub, tag, p, turn, node, raw in pdf.itertuples(index=False):
                h = np.frombuffer(raw, np.uint64)
                if not turn:
                    at, mine = (hub, tag, p), h
                elif at == (hub, tag, p) and _linked(np.array(len(np.intersect1d(mine, h, assume_unique=True))), len(mine), np.array(len(h))):
                    found.append((hub, node))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    places = rows.repartition("hub", "hub_tag", "part").sortWithinPartitions("hub", "hub_tag", "part", "turn")
    return places.mapInPandas(compare, "a long, b long")


def _gathered(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each place, from batches sorted by place; a place may go on in the next batch."""
    kept: list[pd.DataFrame] = []
    last = np.empty(0)
    for pdf in batches:
        k = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(pdf)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if kept and (k[at] != last).any():
                yield kept[0] if len(kept) == 1 else pd.concat(kept)
                kept = []
            if to > at:
                kept.append(pdf.iloc[at:to])
                last = k[at]
    if kept:
        yield pd.concat(kept)


def _places(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """members with (i, j, mine): a band's members are cut into blocks, and every two blocks meet in one place."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(blocks, "band").withColumn("mine", F.pmod(F.xxhash64("node", "tag"), "blocks").cast("int")).withColumn("_other", other)
    return dealt.withColumns({"i": F.least("mine", "_other"), "j": F.greatest("mine", "_other")}).drop("_other", "blocks")


def likely(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, tag) of the members of a bucket with a partner of another component whose sketch agrees often enough.

    A pair is looked at in the first band that it shares. members: (band, node, tag, component, low, bands).
    """
    blocks = scratch.written(members.groupBy("band").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("blocks")), "blocks")

    def some_of(g: pd.DataFrame) -> np.ndarray:
        low = np.frombuffer(b"".join(g["low"]), np.uint8).reshape(len(g), -1)
        keys, band = np.frombuffer(b"".join(g["bands"]), np.int64).reshape(len(g), -1), g["band"].iat[0]
        c, n = g["component"].to_numpy(), g["tag"].to_numpy() >> 32
        one, first = g["i"].iat[0] != g["j"].iat[0], g["mine"].to_numpy() == g["i"].iat[0]
        some = np.zeros(len(g), bool)
        for k in np.flatnonzero(first) if one else range(len(g) - 1):
            rest = np.flatnonzero(~first) if one else np.arange(k + 1, len(g))
            rest = rest[(c[rest] != c[k]) & (np.minimum(n[rest], n[k]) * 100 >= np.maximum(n[rest], n[k]) * PERCENT)]
            rest = rest[~some[rest]] if some[k] else rest
            if len(rest) and len(rest := rest[(low[rest] == low[k]).sum(1) >= AGREE]):
                rest = rest[keys[k][(keys[rest] == keys[k]).argmax(1)] == band]
                some[rest] = some[k] = some[k] or len(rest) > 0
        return some

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for g in _gathered(batches, ["band", "i", "j"]):
            if (some := some_of(g)).any():
                held.append(g.loc[some, ["band", "node", "tag"]])
                if len(held) >= 500:
                    yield pd.concat(held)
                    held = []
        if held:
            yield pd.concat(held)

    places = _places(members, blocks).select("band", "i", "j", "mine", "node", "tag", "component", "low", "bands")
    return places.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInPandas(run, "band long, node long, tag long").distinct()


def joining(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between members of a band, by whole sets, that join different components; no more than join them.

    members: (band, node, tag, component).
    """
    blocks = scratch.written(members.groupBy("band").agg(F.ceil(F.sum(_size("tag")) / SHINGLES).cast("int").alias("blocks")), "blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _gathered(batches, ["band", "i", "j"]):
            if found := list(_links([np.frombuffer(h, np.uint64) for h in g["hashes"]], g["component"].to_numpy().copy())):
                node = g["node"].to_numpy()
                yield pd.DataFrame({"a": [node[a] for a, _ in found], "b": [node[b] for _, b in found]}, dtype="int64")

    places = _places(members, blocks).select("band", "i", "j", "node", "tag", "component").join(sets.select("node", "tag", "hashes"), ["node", "tag"])
    places = places.select("band", "i", "j", "node", "component", "hashes").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return places.mapInPandas(run, "a long, b long")


def _links(sets: list[np.ndarray], c: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of two linked sets of different components c, which are then one."""
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    owner, values = owner[order], every[order]
    for k in range(len(sets) - 1):
        if (c == c[0]).all():
            return
        rest = np.flatnonzero((c != c[k]) & (np.arange(len(sets)) > k))
        if not len(rest):
            continue
        a, b = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
        run = b - a
        at = np.repeat(a - np.cumsum(run) + run, run) + np.arange(run.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for r in rest[_linked(both[rest], sizes[k], sizes[rest])]:
            if c[r] != c[k]:
                yield k, int(r)
                c[c == c[r]] = c[k]


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of each node that has an edge (a, b); component is the least node reachable.

    Every round points each node at its least neighbour, hangs its other
    neighbours there too, and lets each target be followed one step on. The sum
    of targets falls until each node has one edge, to a root.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        least = scratch.written(e.groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n")), "least")
        p = least.select("u", "p")
        up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        if least.where("n > 1").isEmpty() and p.join(up, "p", "left_semi").isEmpty():
            return p.select(F.col("u").alias("node"), F.col("p").alias("component")).union(p.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())
        followed = p.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("v"))
        hung = e.join(p, "u").where("v != p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        e = scratch.written(followed.union(hung).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")


def crowds(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, node, tag, hub, hub_tag, shared) of the members of buckets with at least two nodes.

    shared is the number of bucket rows that the hub meets in all its bands.
    """
    members = entries.select(F.explode("bands").alias("band"), "node", "tag")
    buckets = scratch.written(members.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "size"), "buckets")
    crowd = scratch.written(members.join(buckets, "band").distinct(), "crowd")
    shared = crowd.groupBy("node", "tag").agg(F.sum("size").alias("shared"))
    ranked = scratch.written(crowd.join(shared, ["node", "tag"]).select("band", "node", "tag", "shared"), "ranked")
    most = ranked.groupBy("band").agg(F.max(F.struct("shared", (-F.col("node")).alias("first"), "tag")).alias("h"))
    hubs = most.select("band", (-F.col("h.first")).alias("hub"), F.col("h.tag").alias("hub_tag"), F.col("h.shared").alias("shared"))
    return scratch.written(ranked.drop("shared").join(hubs, "band"), "members")


def links(docs: DataFrame, entries: DataFrame, same: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the nodes that have a link; entries: (node, tag, bands), same: links (a, b) known before."""
    crowd = crowds(entries, scratch)
    scratch.clear("signatures", "copies", "buckets", "crowd", "ranked")
    sets = scratch.written(whole_sets(docs, crowd.select("node").distinct(), words), "sets")
    pairs = crowd.where("node != hub").where(_fit(_size("tag"), _size("hub_tag")))
    pairs = scratch.written(pairs.groupBy("hub", "hub_tag", "node", "tag").agg(F.max("shared").alias("shared")), "pairs")
    first = pairs.groupBy("node", "tag").agg(F.max(F.struct("shared", (-F.col("hub")).alias("first"), "hub_tag")).alias("h"))
    edges = scratch.written(verified(first.select((-F.col("h.first")).alias("hub"), F.col("h.hub_tag").alias("hub_tag"), "node", "tag"), sets, scratch).union(same), "links")

    def labelled(rows: DataFrame, label: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(label.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    label = scratch.written(components(edges, scratch), "labels")
    open_ = labelled(labelled(pairs.drop("shared"), label, "node", "_a"), label, "hub", "_b").where("_a != _b").drop("_a", "_b")
    edges = edges.union(scratch.written(verified(open_, sets, scratch), "links"))
    label = scratch.written(components(edges, scratch), "labels")
    members = labelled(crowd.select("band", "node", "tag"), label, "node", "component")
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    left = scratch.written(members.join(mixed.select("band"), "band"), "mixed")
    met = scratch.written(likely(left.join(sets.select("node", "tag", "low", "bands"), ["node", "tag"]), scratch), "likely")
    if not met.isEmpty():
        edges = edges.union(scratch.written(joining(labelled(met, label, "node", "component"), sets, scratch), "links"))
        label = components(edges, scratch)
    return label


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.written(signatures(docs, words), "signatures")
    sized = sig.where("set_key is not null and doc_id is not null")
    copies = scratch.written(sized.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("set_key", "rep"), "copies")
    plain = scratch.written(sig.select("doc_id", "n_shingles", "set_key").join(copies, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes", lasting=True)
    entries = sized.join(copies, "set_key", "left").where("rep is null or rep = doc_id").select(F.col("doc_id").alias("node"), "tag", "bands")
    # a doc_id with rows of different texts ties their classes together
    repeated = plain.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    same = scratch.written(repeated.select("a", "b").union(repeated.select(F.col("doc_id").alias("a"), "b")), "same")
    label = scratch.written(links(docs, entries, same, words, scratch), "labels", lasting=True)
    scratch.clear()
    out = plain.join(label, plain["rep"] == label["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with the first document of each class alone; of rows that repeat its id, the one with the least text."""
    found = classes(docs, STAGE_WORDS)
    repeated = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    gone = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).union(repeated), "gone")
    id_ = docs["doc_id"].cast("long")
    kept = docs.join(gone, id_ == gone["_id"], "left_anti")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(repeated, id_ == repeated["_id"], "left_semi").groupBy(id_.alias("_id")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("_row"))
    return kept.union(one.select("_row.*"))
