"""Near-duplicates by 64-bit fingerprints, compared bit plane by bit plane.

A text's fingerprint has a bit where more than half of its shingles' hashes have
it: XXH64 with seed 42 of the UTF-8 of three words with a space between them,
repeats included; with fewer words the whole sequence is the one shingle.
Fingerprints with at most RADIUS differing bits are linked, and a component is
what links reach.

Equal fingerprints are one class, represented by the smallest id. Of four runs of
16 bits two are equal in every linked pair, so each choice of two runs is a key,
and pairs are compared within a key alone. A place with over CROWD members is
dealt anew by two of four runs of 8 of its other 32 bits, which must be equal for
the same reason; 16 bits are then free, so no place ever has over 65,536 members,
however alike the corpus is, and nothing is cut off.

Within a place the bits that are free stand in vertical planes: a word holds one
bit of 64 members. Two planes at a time are compared with a member and added to
the 64 distances by a carry-save adder: `ones`, `twos` and `over` hold them in
binary. Words whose members are all beyond the radius are given up every four
planes; most go after eight. A place gives at most a link for each member, those
that join what it has linked.

Nulls, empty and blank texts have the fingerprint zero, linked like any other. A
row without a doc_id has a fingerprint, no component, and links nothing. Rows
that repeat a doc_id are one node, so their fingerprints are in one component.
Long texts are hashed whole, SLICE shingles at a time. Extra columns are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .neardup import components

WORDS, SEED, RADIUS = 3, 42, 2
#: Members of a place that is not dealt anew, shingles hashed at a time, words of planes compared at a time, and rows gathered before places are compared.
CROWD, SLICE, PLANES, ROWS = 4096, 65_536, 1 << 18, 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n, counts, digest = max(len(found) - words + 1, 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    if not found:
        return 0
    for at in range(0, n, SLICE):
        part = found[at : at + SLICE + words - 1]
        texts = map(b" ".join, zip(*[part[i:] for i in range(words)], strict=False)) if len(found) >= words else [b" ".join(found)]
        h = np.fromiter([digest(s, SEED) for s in texts], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's bits as a signed number."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), run("text").alias("fp"))


def _run(x: Column, i: int, bits: int) -> Column:
    """Run i of so many bits, counted from the lowest."""
    return F.shiftrightunsigned(x, i * bits).bitwiseAND((1 << bits) - 1)


def _choices(x: Column, bits: int) -> list[tuple[Column, Column]]:
    """(two of four runs, the other two), for each choice of two."""
    both = lambda i, j: F.shiftleft(_run(x, i, bits), bits).bitwiseOR(_run(x, j, bits))
    return [(both(i, j), both(*(k for k in range(4) if k not in (i, j)))) for i, j in combinations(range(4), 2)]


def places(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(place, free, rep): each class at its six keys; at a crowded one, at the six of its free bits instead."""
    keyed = [F.struct(F.lit(k << 32).bitwiseOR(key).alias("key"), free.alias("free")) for k, (key, free) in enumerate(_choices(F.col("fp"), 16))]
    entries = classes.select("rep", F.explode(F.array(*keyed)).alias("e")).select("rep", "e.*")
    crowds = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key", F.lit(True).alias("crowded"))
    deeper = F.array(*[F.lit(k + 1 << 16).bitwiseOR(key) for k, (key, _) in enumerate(_choices(F.col("free"), 8))])
    again = F.explode(F.when(F.col("crowded"), deeper).otherwise(F.array(F.lit(0).cast("long")))).alias("sub")
    return entries.join(crowds, "key", "left").select("key", "free", "rep", again).select(F.shiftleft("key", 20).bitwiseOR(F.col("sub")).alias("place"), "free", "rep")


def near(place: np.ndarray, free: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j), i < j, of the rows of one place whose free bits, 32 of them, differ in at most RADIUS; rows are sorted by place."""
    n = len(place)
    ends = np.searchsorted(place, place, "right")
    bits = np.zeros((32, -(-n // 64) * 64), np.uint8)
    for b in range(32):
        bits[b, :n] = free >> b & 1
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    own = _ALL * bits[:, :n].astype(np.uint64)  # all ones where the row has the bit
    first = (np.arange(n) + 1) // 64
    words = np.where(ends > np.arange(n) + 1, (ends - 1) // 64 - first + 1, 0)
    upto = np.cumsum(words)
    at = 0
    while at < n:  # rows whose words fit in one slice, at least one row
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLANES, "right")))
        row = np.repeat(np.arange(at, to), words[at:to])
        word = np.arange(len(row)) - np.repeat(np.cumsum(words[at:to]) - words[at:to], words[at:to]) + first[row]
        at = to
        low, high = np.maximum(row + 1 - 64 * word, 0), np.minimum(ends[row] - 64 * word, 64)
        live = (_ALL << low.astype(np.uint64)) & (_ALL >> (64 - high).astype(np.uint64))
        ones, twos, over = (np.zeros(len(row), np.uint64) for _ in range(3))
        for b in range(0, 32, 2):
            x, y = planes[b, word] ^ own[b, row], planes[b + 1, word] ^ own[b + 1, row]
            half = ones ^ x
            carry = (ones & x) | (half & y)
            ones = half ^ y
            over |= twos & carry
            twos ^= carry
            if b % 4 == 2:
                live &= ~(over | (ones & twos))
                keep = live != 0
                if not keep.all():
                    row, word, live, ones, twos, over = (v[keep] for v in (row, word, live, ones, twos, over))
        pair, lane = np.nonzero(np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield row[pair], word[pair] * 64 + lane


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, the least row known to be reached from each, after links between rows i and j."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def links(at: DataFrame) -> DataFrame:
    """(a, b): links between classes, for each place no more than join what it links."""

    def found(rows: list[np.ndarray]) -> pd.DataFrame:
        r = rows[0] if len(rows) == 1 else np.concatenate(rows)
        label = np.arange(len(r))
        for i, j in near(r[:, 0], r[:, 1]):
            label = _joined(label, i, j)
        moved = np.flatnonzero(label != np.arange(len(r)))
        return pd.DataFrame({"a": r[moved, 2], "b": r[label[moved], 2]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        count = 0
        for pdf in batches:
            r = pdf.to_numpy(np.int64)
            cut = int(np.searchsorted(r[:, 0], r[-1, 0])) if len(r) else 0
            if count + cut >= ROWS and (cut or held[-1][-1, 0] != r[0, 0]):  # the last place may go on in the next batch
                out = found([*held, r[:cut]])
                held, count = [], 0
                yield out
                r = r[cut:]
            if len(r):
                held.append(r)
                count += len(r)
        if held:
            yield found(held)

    return at.select("place", "free", "rep").repartition("place").sortWithinPartitions("place").mapInPandas(run, "a long, b long")


def classes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.written(fingerprints(docs), "prints", lasting=True)
    known = prints.where("doc_id is not null")
    equal = scratch.written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "equal", lasting=True)
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    same = known.join(repeated, "doc_id").join(equal, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = scratch.written(links(places(equal, crowd)).union(same), "near")
    label = scratch.written(components(edges, scratch), "labels", lasting=True)
    scratch.clear()
    reps = equal.join(label, equal["rep"] == label["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(reps, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
