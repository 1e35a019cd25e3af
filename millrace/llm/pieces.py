"""Encoding and decoding by merge-type pieces, as a sentencepiece model of that type defines them.

The encoding of a word is the only sequence of pieces in which every adjacent
pair is stable: merging the pair's text anew gives the pair. It is found by
backtracking: one pass of an Aho-Corasick automaton tells the longest piece that
begins at each place; it is taken if it is compatible with the piece before,
else the next shorter one that it begins with; a bitfield marks places from
which no way leads on. Compatibility is found by re-merging a pair's text and
remembered by pair.

A space is the mark U+2581, and one is put before a text. No piece has a mark
after another character, which is checked, so no merge crosses the beginning of
a word and words are encoded one by one; a task remembers a set number of them.
Characters without a piece become byte pieces, and no merge crosses them.

Nulls count as empty texts. Repeated rows encode alike. Extra columns stay,
whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """Encodes texts with the vocabulary of a model file."""

    def __init__(self, path: str, remembered: int = 250_000):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, size = self.model, self.model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(size):
            if m.is_byte(i):
                self.bytes[int(m.id_to_piece(i)[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[m.id_to_piece(i)] = i
        self.order = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.bos, self.eos, self.unknown = m.bos_id(), m.eos_id(), m.unk_id()
        #: Runs of characters that are pieces themselves; no merge crosses another character.
        self.runs = re.compile(f"([{''.join(re.escape(p) for p in self.ids if len(p) == 1)}]+)")
        #: Characters that no piece of several has, so that nothing merges across them.
        self.breaks = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside, so words can't be encoded one by one")
        self.automaton = ahocorasick.Automaton()
        self.real: dict[str, int] = {p: i for p, i in self.ids.items() if self._merged(p) == [p]}  # merging never makes the others
        for p, i in self.real.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: For each piece the next shorter one that it begins with.
        self.shorter = {i: next((self.real[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.real), -1) for p, i in self.real.items()}
        self.length = {i: len(p) for p, i in self.real.items()}
        self.stable: dict[int, bool] = {}
        self.most, self.known, self.older = remembered, {}, {}

    def _merged(self, text: str) -> list[str]:
        """The text merged pair by pair, best score first, then leftmost."""
        parts, order = list(text), self.order
        while len(parts) <= 24:  # short: look at every pair
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                o = order.get(parts[i] + parts[i + 1], math.inf)
                if o < best:
                    best, at = o, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        after, before = list(range(1, len(parts))) + [-1], list(range(-1, len(parts) - 1))
        heap = [(order[s], i, s) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in order]
        heapq.heapify(heap)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != s:
                continue
            parts[i], parts[j] = s, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (t := s + parts[k]) in order:
                    heapq.heappush(heap, (order[t], i, t))
            if (k := before[i]) >= 0 and (t := parts[k] + s) in order:
                heapq.heappush(heap, (order[t], k, t))
        return [p for p in parts if p]

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.stable) > 400_000:
            self.stable.clear()
        p, q = self.pieces[a], self.pieces[b]
        self.stable[a << 32 | b] = ok = self._merged(p + q) == [p, q]
        return ok

    def _plain(self, character: str) -> list[int]:
        return [self.bytes[b] or self.unknown for b in character.encode("utf-8", "replace")]

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text whose every character is a piece."""
        stable, shorter, length = self.stable, self.shorter, self.length
        n, at, last, out = len(text), 0, -1, []
        longest, failed = [-1] * n, bytearray(n // 8 + 1)
        for end, i in self.automaton.iter(text):  # all pieces by their ends, so of those with one beginning the longest comes last
            longest[end + 1 - length[i]] = i
        i = longest[0]
        while at < n:
            while i >= 0:
                to = at + length[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if last < 0 or ((ok := stable.get(last << 32 | i)) is None and self._compatible(last, i)) or ok:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += length[i]
                last = i
                i = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no stable sequence of pieces for {text[:80]!r}")
                i = out.pop()
                at -= length[i]
                i, last = shorter[i], out[-1] if out else -1
        return out

    def word(self, text: str) -> bytes:
        """Ids, 32 bits each, of a word with the marks before it, or of a part of a word."""
        got = self.known.get(text) or self.older.get(text)
        if got is None:
            ids: list[int] = []
            for k, run in enumerate(self.runs.split(text)):
                ids += self._backtrack(run) if k % 2 else [i for c in run for i in self._plain(c)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= 64:
            if len(self.known) >= self.most:  # words that weren't met since the last time go
                self.known, self.older = {}, self.known
            self.known[text] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, with begin and end, as little-endian unsigned 32-bit integers."""
        ends = struct.pack("<2I", self.bos, self.eos)
        if not text:
            return ends
        text = MARK + text.replace(" ", MARK)
        parts = []
        for line in re.split(f"([{self.breaks}])", text) if self.breaks else [text]:
            parts += _WORDS.findall(line)
        return ends[:4] + b"".join([self.known.get(w) or self.word(w) for w in parts]) + ends[4:]

    def decode(self, ids: bytes) -> str:
        """The text of ids as encode() gives them."""
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, so tasks that follow use what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str | None = None, column: str = "pieces") -> DataFrame:
    """docs with a struct of `ids` (binary, four bytes an id) and `decoded`, the text those ids give."""
    path = path or default_model()

    @F.pandas_udf("struct<ids:binary,decoded:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for texts in batches:
            ids = [e.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [e.decode(i) for i in ids]})

    return docs.withColumn(column, run("text"))


def _digests(pieces: str) -> list[Column]:
    ids, decoded = F.col(f"{pieces}.ids"), F.col(f"{pieces}.decoded")
    return [(F.length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256")]


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *_digests("pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix keeps as training data: their columns but the text, `ids` (binary, four bytes an id), counts and digests.

    A column of theirs with such a name stays, and the new one gets an underscore before its name.
    """
    pieces = free_name(docs, "_pieces")
    own = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    new = [F.col(f"{pieces}.ids").alias("ids"), *_digests(pieces)]
    names = [free_name(docs.drop("text"), n) for n in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    return encoded(docs, column=pieces).select(*own, *[c.alias(n) for c, n in zip(new, names, strict=True)])
