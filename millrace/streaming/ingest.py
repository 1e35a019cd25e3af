"""Records that peers send, one after another: taken, replaced, refused or pushed out, with what became of each.

A step takes a key's state and a record and gives the state after it and what is
said. The same step runs over a batch, where a key's records stream by in order,
and over a stream, where the state is kept as text between batches. States hold
at most what their bounds allow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.layout import carried

Step = Callable[[dict | None, tuple], tuple[dict, tuple]]
NOTES = "outcome string, evicted long, held long"
ENTRIES = "outcome string, evicted long, held long, bytes_held long"


def note_step(most: int, cap: int, least_ttl: int, most_ttl: int, window: int = 60) -> Step:
    """Of (now, event, note, expires, empty), seconds: what has expired goes, then the limit of `most` records a window decides, then the note is adopted.

    A note lives from `least_ttl` to `most_ttl` by this side's clock, replaces one of its name, and pushes out those that expire soonest
    (then the older, then the lesser name) beyond the cap; a refused note still counts as heard, not as held.
    """

    def step(state: dict | None, row: tuple) -> tuple[dict, tuple]:
        now, _, note, expires, empty = row
        state = state or {"notes": {}, "since": 0, "used": 0}
        notes = {k: v for k, v in state["notes"].items() if v[0] > now}
        since, used = (now, 0) if now - state["since"] >= window else (state["since"], state["used"])
        evicted, outcome = 0, "rate limited"
        if used < most:
            used += 1
            if empty:
                outcome = "empty"
            else:
                outcome = "replaced" if note in notes else "accepted"
                notes[note] = [now + min(max(expires - now, least_ttl), max(most_ttl, least_ttl)), now]
                while len(notes) > cap:
                    del notes[min(notes, key=lambda k: (*notes[k], k))]
                    evicted += 1
        return {"notes": notes, "since": since, "used": used}, (outcome, evicted, len(notes))

    return step


def entry_step(cap: int, most_bytes: int, ttl: int) -> Step:
    """Of (now, event, query, bytes, own_ttl): an entry of the same query goes, the new one lives for its own time or the store's (0: for ever),
    and the least recently stored go until both bounds hold, never the new one."""

    def step(state: dict | None, row: tuple) -> tuple[dict, tuple]:
        now, _, query, size, own = row
        entries = {k: v for k, v in (state or {}).items() if v[1] is None or v[1] > now}  # in the order in which they were stored
        outcome = "replaced" if entries.pop(query, None) else "stored"
        lives = ttl if own is None else own
        entries[query] = [size, now + lives if lives > 0 else None]
        evicted, held = 0, sum(v[0] for v in entries.values())
        while len(entries) > 1 and (len(entries) > cap or held > most_bytes):
            held -= entries.pop(next(iter(entries)))[0]
            evicted += 1
        return entries, (outcome, evicted, len(entries), held)

    return step


def replayed(rows: DataFrame, key: str, columns: list[str], step: Step, said: str) -> DataFrame:
    """rows (key, now, event, ...) with what the step says, each key's in order of moment and event."""
    kinds = {"bigint": "long", **{k: k for k in ("int", "double", "string", "boolean", "binary")}}
    types = dict(rows.dtypes)
    return carried(rows, key, columns[:2], step, columns, ", ".join([*(f"{c} {kinds[types[c]]}" for c in (key, *columns)), said]))


def streamed(rows: DataFrame, key: str, columns: list[str], step: Step, said: str, forget_ms: int) -> DataFrame:
    """(key, event, what the step says) over a stream; a key's state goes when nothing has come for forget_ms of processing time."""
    names = [key, columns[1], *(c.split()[0] for c in said.split(", "))]
    sent = [F.col(c).cast("string").alias(c) if t == "bigint" else F.col(c) for c, t in dict(rows.select(*columns).dtypes).items()]  # whole beside nulls
    numbers = [t == "bigint" for t in dict(rows.select(*columns).dtypes).values()]

    def run(at: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else None
        every = [tuple(None if v is None else int(v) if n else v for v, n in zip(r, numbers, strict=True)) for pdf in batches for r in pdf[columns].itertuples(index=False, name=None)]
        out = []
        for row in sorted(every, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
            state, what = step(state, row)
            out.append((at[0], row[1], *what))
        held.update((json.dumps(state),))
        held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=names, dtype=object)

    schema = f"{key} {dict(rows.dtypes)[key]}, {columns[1]} {dict(rows.dtypes)[columns[1]]}, {said}"
    return rows.select(key, *sent).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
