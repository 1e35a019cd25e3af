"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokenizer A has byte-level pieces, B has pieces of characters with bytes where it
has no piece; both encode a space and the text. Every byte has a label: none, A's
token ends here, B's does, or both. A pattern scans the labels in spans up to each
`both`, and the labels in a span tell how many tokens of A and of B are a group.
Within a group, the ends of both cut it into pieces, each of which lies in one
token of A and one of B: those pieces are the links, every overlapping pair once.

How often an id pair is linked is counted over the whole corpus. Texts are aligned
once, and a table keeps each text's distinct pairs with their counts, packed into
bytes. A pass over it gives each batch's distinct pairs, which are summed; a second
looks up the sums. Pairs with more than a FREQUENT-th of all links are at most
FREQUENT and are sent to every task; the others are joined by a shuffle, in which
no pair then holds more than such a part. A B id's highest count is a row for each
id, as many as the vocabulary has, and is part of the pairs' table.

Texts are cut where a space stands alone between two characters that are not
white space: A's pattern begins a token at such a space, and no piece of B has its
mark after another character, so neither makes a token across it. This is checked
for B (else texts stay whole); the aligned words are remembered in two generations.

Null and empty texts have no tokens, nor has a text whose tokens' bytes are not a
space and the text in both (a text with B's mark in it, or with characters that B's
normaliser changes): zeros and an empty digest. Rows are independent, whatever
their doc_id. Long texts are aligned whole. Extra columns are allowed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MARK = "▁"
#: At most so many pairs are sent to every task; words that a generation remembers, and characters of those.
FREQUENT, REMEMBERED, SHORT = 1 << 18, 200_000, 64

_WORD_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPAN = re.compile(rb"[^\x03]*\x03", re.DOTALL)
#: The pattern by which A's kind of tokenizer cuts a text before it merges; a fixed value.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def byte_encoder(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """(encode, bytes by id) of a byte-level vocabulary; special tokens are plain text.

    If each merge's result has the next id, ids are ranks, and the quicker library encodes; otherwise the vocabulary's own.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of, vocab = byte_characters(), model["vocab"]
    of = {i: bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for p, i in vocab.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and all(len(of[i]) == 1 for i in range(256)):
        ranks = {of[i]: i for i in range(256 + len(merges))}
        encode = tiktoken.Encoding("own", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        encode = lambda s: t.encode(s, add_special_tokens=False).ids
    return encode, [of.get(i, b"") for i in range(max(of) + 1)]


def piece_encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes], bool]:
    """(encode texts, bytes by id, whether words can be encoded one by one) of a model of pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    of = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    return lambda texts: m.encode(texts, num_threads=1), of, not any(MARK in p.lstrip(MARK) for p in pieces)


class Aligned(NamedTuple):
    """A word's or a text's alignment: groups as text, and links as a << 32 | b, eight bytes each."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


#: Of words whose bytes are others.
OTHER = Aligned(0, 0, 0, "", b"")


def align(a: list[list[int]], b: list[list[int]], a_lengths: np.ndarray, b_lengths: np.ndarray, with_groups: bool = True) -> list[Aligned]:
    """The alignment of each of some words from their ids in both; the words' labels stand one after another, so no span crosses a word."""
    flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
    of_a, of_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    a_ends = a_lengths[flat_a].cumsum()
    label = np.zeros(int(a_ends[-1]), np.uint8)
    label[a_ends - 1] = 1
    label[b_lengths[flat_b].cumsum() - 1] |= 2
    cuts = np.flatnonzero(label)
    kind = label[cuts]
    links = (flat_a[(kind & 1).cumsum() - (kind & 1)] << 32 | flat_b[(kind >> 1).cumsum() - (kind >> 1)]).tobytes()
    word_ends = a_ends[of_a.cumsum() - 1] - 1
    to_link = np.searchsorted(cuts, word_ends, "right").tolist()
    to_group = np.searchsorted(cuts[kind == 3], word_ends, "right").tolist()
    groups, i, j = [], 0, 0
    if with_groups:
        a_text, b_text = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        for span in _SPAN.findall(label.tobytes()):
            if len(span) == 1 or (x := span.count(1)) + (y := span.count(2)) == 0:
                groups.append(f"{a_text[i]}|{b_text[j]}")
                i, j = i + 1, j + 1
            else:
                groups.append(f"{','.join(a_text[i : i + x + 1])}|{','.join(b_text[j : j + y + 1])}")
                i, j = i + x + 1, j + y + 1
    of_a, of_b, out, at, link = of_a.tolist(), of_b.tolist(), [], 0, 0
    for w in range(len(of_a)):
        out.append(Aligned(of_a[w], of_b[w], to_group[w] - at, ";".join(groups[at : to_group[w]]), links[8 * link : 8 * to_link[w]]))
        at, link = to_group[w], to_link[w]
    return out


class Aligner:
    """Aligns texts word by word and remembers words."""

    def __init__(self, a_path: str, b_path: str, with_groups: bool = True):
        self.a, self.a_bytes = byte_encoder(a_path)
        self.b, self.b_bytes, self.by_words = piece_encoder(b_path)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in of]) for of in (self.a_bytes, self.b_bytes))
        self.with_groups = with_groups
        self.known: dict[str, Aligned] = {}
        self.older: dict[str, Aligned] = {}

    def words(self, text: str | None) -> list[str]:
        return [] if not text else _WORD_CUT.split(text) if self.by_words else [text]

    def _same(self, word: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + word.encode("utf-8", "replace")
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def _new(self, words: list[str]) -> list[Aligned]:
        a, b = [self.a(" " + w) for w in words], self.b(words)
        raw = (" " + " ".join(words)).encode("utf-8", "replace")
        if all(b) and b"".join([self.a_bytes[i] for x in a for i in x]) == raw == b"".join([self.b_bytes[i] for x in b for i in x]):
            return align(a, b, self.a_lengths, self.b_lengths, self.with_groups)
        out = [OTHER] * len(words)
        good = [k for k, w in enumerate(words) if self._same(w, a[k], b[k])]
        for k, x in zip(good, align([a[k] for k in good], [b[k] for k in good], self.a_lengths, self.b_lengths, self.with_groups) if good else [], strict=True):
            out[k] = x
        return out

    def of_words(self, words: Iterable[str]) -> dict[str, Aligned]:
        """The alignments of distinct words, each with the space before it; OTHER where the bytes are others."""
        known, older = self.known.get, self.older.get
        out = {w: known(w) or older(w) for w in words}
        if new := [w for w, x in out.items() if x is None]:
            out.update(zip(new, self._new(new), strict=True))
        if len(self.known) >= REMEMBERED:  # words that weren't met since the last time go
            self.known, self.older = {}, self.known
        self.known.update([x for x in out.items() if len(x[0]) <= SHORT])
        return out

    def texts(self, texts: Iterable[str | None]) -> tuple[list[list[str]], dict[str, Aligned]]:
        """The words of each text, none where it has no tokens, and the alignments of all words."""
        parts = [self.words(t) for t in texts]
        of = self.of_words(dict.fromkeys(chain.from_iterable(parts)))
        if bad := {w for w, x in of.items() if x is OTHER}:
            parts = [[] if bad.intersection(p) else p for p in parts]
        return parts, of


_aligners: dict[tuple, Aligner] = {}


def aligner(*way) -> Aligner:
    """One aligner a worker process, so tasks that follow use what it remembers; a new way takes the old one's place."""
    if way not in _aligners:
        _aligners.clear()
        _aligners[way] = Aligner(*way)
    return _aligners[way]


class Pairs:
    """Distinct id pairs of a text and how often each is linked, as bytes: differences of sorted numbers a * ids_of_b + b, then counts."""

    def __init__(self, ids_of_a: int, ids_of_b: int):
        self.ids_of_b, self.kind = ids_of_b, np.dtype("<u4" if ids_of_a * ids_of_b < 1 << 32 else "<u8")
        self.packer, self.unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def packed(self, links: bytes) -> bytes:
        x = np.frombuffer(links, np.int64)
        pair, n = np.unique((x >> 32) * self.ids_of_b + (x & 0xFFFFFFFF), return_counts=True)
        return self.packer.compress(np.diff(pair, prepend=0).astype(self.kind).tobytes() + n.astype(self.kind).tobytes())

    def unpacked(self, many: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, counts, how many are of each text) of the texts' bytes, those of no tokens empty."""
        parts = [np.frombuffer(self.unpacker.decompress(b), self.kind).astype(np.int64).reshape(2, -1) if b else np.empty((2, 0), np.int64) for b in many]
        return np.concatenate([p[0].cumsum() for p in parts]), np.concatenate([p[1] for p in parts]), np.array([p.shape[1] for p in parts])


def token_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of each row of docs; pairs as Pairs packs them."""

    @F.pandas_udf("struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,pairs:binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        al = aligner(*paths)
        packer = Pairs(len(al.a_bytes), len(al.b_bytes))
        for texts in batches:
            parts, of = al.texts(texts)
            number = {w: i for i, w in enumerate(of)}
            known = list(of.values())
            counts = np.column_stack([np.fromiter((x[k] for x in known), np.int64, len(known)) for k in range(3)])
            groups, links, out = [x.groups for x in known], [x.links for x in known], []
            for words in parts:
                if not words:
                    out.append((0, 0, 0, 0, "", b""))
                    continue
                at = [number[w] for w in words]
                digest = hashlib.sha256(";".join([groups[i] for i in at]).encode()).hexdigest()
                every = b"".join([links[i] for i in at])
                out.append((*counts[at].sum(0).tolist(), len(every) // 8, digest, packer.packed(every)))
            yield pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), run("text").alias("x")).select("row", "doc_id", "x.*")


def pair_counts(rows: DataFrame, ids: tuple[int, int]) -> DataFrame:
    """(pair, n, best): how many links have an id pair, and whether no pair of its B id has more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Pairs(*ids)
        for pdf in batches:
            every, times, _ = packer.unpacked(pdf["pairs"]) if len(pdf) else (np.empty(0, np.int64),) * 3
            pair, at = np.unique(every, return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, times)
            yield pd.DataFrame({"pair": pair, "n": n})

    counts = rows.select("pairs").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair") % ids[1]
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("high"))
    return counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("high")).alias("best"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs."""
    paths = paths or default_paths()
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ids = len(byte_encoder(paths[0])[1]), len(piece_encoder(paths[1])[1])
    rows = scratch.written(token_rows(docs, paths), "tokens", lasting=True)
    counts = scratch.written(pair_counts(rows, ids), "pairs", lasting=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent > total  # so at most `frequent` pairs
    top = counts.where(often).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))

    @F.pandas_udf("struct<n_best:long,count_sum:long,rest:array<long>,times:array<long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (pair, n, best), packer = sent.value, Pairs(*ids)
        for packed in batches:
            every, times, size = packer.unpacked(packed) if len(packed) else (np.empty(0, np.int64),) * 3
            own, back = np.unique(every, return_inverse=True)
            at = np.searchsorted(pair, own)
            at[at == len(pair)] = 0
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            n_own, best_own = (np.where(hit, x[at], 0) if len(pair) else np.zeros(len(own), np.int64) for x in (n, best))
            ends = np.concatenate([[0], size.cumsum()])
            sums = [np.concatenate([[0], (x[back] * times).cumsum()]) for x in (n_own, best_own)]
            other = ~hit[back]
            yield pd.DataFrame({
                "n_best": np.diff(sums[1][ends]), "count_sum": np.diff(sums[0][ends]),
                "rest": [every[a:b][other[a:b]] for a, b in zip(ends, ends[1:], strict=False)], "times": [times[a:b][other[a:b]] for a, b in zip(ends, ends[1:], strict=False)],
            })

    summed = scratch.written(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", run("pairs").alias("x")).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "x.*"), "aligned", lasting=True)
    rest = summed.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.times").alias("times"))
    found = rest.join(counts.where(~often), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    whole = summed.drop("rest", "times").join(found, "row", "left")
    added = {c: F.col(c) + F.coalesce(x, F.lit(0)) for c, x in (("n_best", "_best"), ("count_sum", "_sum"))}
    return whole.withColumns(added).drop("row", "_sum", "_best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
