"""Keyed state over event streams: throttling and token buckets, as replay of a batch or as a stream.

A replay sorts each key's events within its partition and carries one small
state from row to row, so a key of any size needs no more memory than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.layout import record_batch

THROTTLE = "user_id long, event_id long, suppressed long"
BUCKET = "user_id long, event_id long, admitted boolean, retry_ms long"
FIXED = "user_id long, event_id long, admitted boolean"
Step = Callable[[tuple | None, int], tuple[tuple, tuple | None]]


def throttle_step(window_ms: int) -> Step:
    """State (last delivery, count since): the first event of a key and each a window after the last delivery are delivered."""

    def step(state: tuple | None, now: int) -> tuple[tuple, tuple | None]:
        last, count = state or (None, 0)
        if last is None or now - last >= window_ms:
            return (now, 0), (count,)
        return (last, count + 1), None

    return step


def bucket_step(requests: int, window_ms: int) -> Step:
    """State (thousandths of a token, moment): a new key starts full, a refused event learns when to try again."""
    capacity = requests * 1000

    def step(state: tuple | None, now: int) -> tuple[tuple, tuple | None]:
        tokens, updated = state or (capacity, now)
        tokens = min(capacity, tokens + min(max(now - updated, 0), window_ms) * capacity // window_ms)
        if tokens >= 1000:
            return (tokens - 1000, now), (True, 0)
        return (tokens, now), (False, max(1, -(-(1000 - tokens) * window_ms // capacity)) if capacity else window_ms)

    return step


def fixed_step(requests: int, window_ms: int) -> Step:
    """State (start, count): a window restarts at the first call at or after its end; refused calls don't count."""

    def step(state: tuple | None, now: int) -> tuple[tuple, tuple | None]:
        start, count = state or (now, 0)
        if now - start >= window_ms:
            start, count = now, 0
        return ((start, count + 1), (True,)) if count < requests else ((start, count), (False,))

    return step


def _ms(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


def replayed(events: DataFrame, step: Step, schema: str) -> DataFrame:
    """What the step gives for each user's events in order of time; events without a user or a moment say nothing. A null event_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, None
        for batch in batches:
            out = []
            moments = batch.column("ts").cast(pa.int64()).to_pylist()  # microseconds
            for u, e, now in zip(batch.column("user_id").to_pylist(), batch.column("event_id").to_pylist(), moments, strict=True):
                if u != user:
                    user, state = u, None
                state, said = step(state, now // 1000)
                if said is not None:
                    out.append((u, e, *said))
            yield record_batch(out, schema)

    timed = events.where("user_id is not null and ts is not null").select("user_id", "event_id", "ts")
    return timed.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInArrow(run, schema)


def streamed(events: DataFrame, step: Step, schema: str, state: str, forget_ms: int) -> DataFrame:
    """The same over a stream; a key's state goes when nothing has come for forget_ms of processing time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now_state, out = tuple(held.get) if held.exists else None, []
        pdf = pd.concat(list(batches))
        pdf = pdf[pdf["ts"].notna()]
        ids = [None if e is None else int(e) for e in pdf["event_id"]]  # sent as text, so that they stay whole beside a null
        for now, _, e in sorted(zip(_ms(pdf["ts"]), [(e is not None, e or 0) for e in ids], ids, strict=True), key=lambda r: r[:2]):
            now_state, said = step(now_state, int(now))
            if said is not None:
                out.append((key[0], e, *said))
        if now_state is None:
            return
        held.update(tuple(int(x) for x in now_state))
        held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=names, dtype=object)

    return events.select("user_id", F.col("event_id").cast("string"), "ts").groupBy("user_id").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def throttled(events: DataFrame, window_ms: int) -> DataFrame:
    """For each user the events that are delivered, at most one a window, each with the number dropped before it."""
    return replayed(events, throttle_step(window_ms), THROTTLE)


def throttled_stream(events: DataFrame, window_ms: int) -> DataFrame:
    return streamed(events, throttle_step(window_ms), THROTTLE, "last long, count long", max(60_000, 8 * window_ms))


def rate_limited(events: DataFrame, requests: int, window_ms: int) -> DataFrame:
    """Token buckets in thousandths of a token."""
    return replayed(events, bucket_step(requests, window_ms), BUCKET)


def rate_limited_stream(events: DataFrame, requests: int, window_ms: int) -> DataFrame:
    """A bucket that nobody has touched for a window is full again, so forgetting it loses nothing."""
    return streamed(events, bucket_step(requests, window_ms), BUCKET, "tokens long, updated long", window_ms)


def fixed_windows(events: DataFrame, requests: int, window_ms: int) -> DataFrame:
    return replayed(events, fixed_step(requests, window_ms), FIXED)
