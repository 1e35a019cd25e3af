"""Texts in passages that know their headings: blocks, pieces of large blocks, and passages packed with an overlap.

A passage is filled with whole blocks up to a target. Headings move on with what
they head, and a passage begins with the last blocks of the one before, as far
as the overlap allows. What is carried on gives way, first come first, where the
next block would pass the ceiling with it; a heading that gives way stays in the
passage's breadcrumb. Blocks larger than the ceiling are cut at sentences, else
at words, else anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET, OVERLAP, MOST = 1200, 200, 2400
SCHEMA = "array<struct<text:string,breadcrumb:string,first_line:int,last_line:int,split:string>>"

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HASHES = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_SENTENCES = re.compile(r".+?(?:[.!?\n]\s+|\Z)", re.S)


class Unit(NamedTuple):
    text: str
    kind: str
    block: int
    path: tuple[str, ...]
    first: int
    last: int
    split: str | None = None


def blocks(text: str) -> Iterator[Unit]:
    """Fences, headings and paragraphs in order, each with the headings above it."""
    lines, path, n, number = text.replace("\r\n", "\n").split("\n"), [], 0, 0
    while n < len(lines):
        line, start = lines[n], n
        if not line.strip():
            n += 1
            continue
        if fence := _FENCE.match(line):
            mark, n = fence[1], n + 1
            closing = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while n < len(lines) and not closing.match(lines[n]):
                n += 1
            n = min(len(lines), n + 1)
            kind = "fence"
        elif (head := _HASHES.match(line)) and head[2]:
            level, title, n, kind = len(head[1]), head[2], n + 1, "heading"
        elif n + 1 < len(lines) and (under := _UNDERLINE.match(lines[n + 1])):
            level, title, n, kind = (1 if under[1][0] == "=" else 2), line.strip(), n + 2, "heading"
        else:
            n, kind = n + 1, "paragraph"
            while n < len(lines) and lines[n].strip() and not _FENCE.match(lines[n]) and not ((h := _HASHES.match(lines[n])) and h[2]) and not (n + 1 < len(lines) and _UNDERLINE.match(lines[n + 1])):
                n += 1
        if kind == "heading":
            path = [(k, t) for k, t in path if k < level] + [(level, title)]
        yield Unit("\n".join(lines[start:n]).strip("\n"), kind, number, tuple(t for _, t in path), start + 1, n)
        number += 1


def pieces(text: str, most: int) -> Iterator[tuple[str, str]]:
    """(piece, how it was cut) of a text that is too large."""
    for parts, how in ((_SENTENCES.findall(text), "sentence"), (re.findall(r"\S+\s*", text), "word")):
        if max(map(lambda p: len(p.rstrip()), parts), default=most + 1) <= most or how == "word":
            held = ""
            for p in parts:
                if held and len((held + p).rstrip()) > most:
                    yield held.rstrip(), how
                    held = ""
                held += p
                while len(held.rstrip()) > most:
                    yield held[:most], "cut"
                    held = held[most:]
            if held.strip():
                yield held.rstrip(), how
            return


def units(text: str, most: int) -> Iterator[Unit]:
    for u in blocks(text):
        if len(u.text) <= most:
            yield u
        else:
            for piece, how in pieces(u.text, most):
                yield u._replace(text=piece, split=how)


def joined(held: list[Unit]) -> str:
    out = ""
    for i, u in enumerate(held):
        out += u.text if not i else (" " if held[i - 1].block == u.block else "\n\n") + u.text
    return out


def passages(text: str | None, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> list[dict]:
    """The passages of a text; null and blank texts have none."""
    if not (overlap < target <= most and target >= 64):
        raise ValueError("overlap < target <= ceiling, and a target of 64 at least")
    out, held, fresh = [], [], 0

    def close(keep: list[Unit]) -> None:
        if keep:
            out.append({"text": joined(keep), "breadcrumb": " > ".join(keep[0].path), "first_line": min(u.first for u in keep), "last_line": max(u.last for u in keep), "split": next((u.split for u in keep if u.split), None)})

    for u in units(text or "", most):
        if held and len(joined([*held, u])) > target and fresh:
            ahead = len(held)
            while ahead and held[ahead - 1].kind == "heading":
                ahead -= 1
            body, heads = held[:ahead], held[ahead:]
            if body:
                close(body)
                tail: list[Unit] = []
                while len(tail) < len(body) - 1 and len(joined([body[-1 - len(tail)], *tail])) <= min(overlap, target // 2):
                    tail.insert(0, body[-1 - len(tail)])
                held = [*tail, *heads]
                fresh = len(heads)
            while held and len(joined([*held, u])) > most:
                held.pop(0)
        held.append(u)
        fresh += 1
    if fresh:
        close(held)
    return out


def chunks(text: Column, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> Column:
    @F.pandas_udf(SCHEMA)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: passages(t, target, overlap, most))

    return cut(text)
