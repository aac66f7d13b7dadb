"""The stateful event gate: one event for each fingerprint, a cap by key, and a token bucket."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAP = 10
BURST = 3
REFILL_MS = 5_000
_ROWS = "user_id long, event_id long, admitted boolean"


def admit(events: Iterable[tuple[int, str]], state: tuple | None = None) -> tuple[list[bool], tuple]:
    """Decisions for (time in ms, fingerprint) in order, and the state after them.

    An event passes if its fingerprint has not passed before, fewer than CAP have passed, and the bucket holds a whole token; the
    bucket starts full and gains one token each REFILL_MS. Events that fail the first two tests leave the bucket alone.
    """
    tokens, last, seen = state if state else (float(BURST), None, ())
    passed, out = set(seen), []
    for now, mark in events:
        ok = mark not in passed and len(passed) < CAP
        if ok:
            tokens = min(float(BURST), tokens + (now - (now if last is None else last)) / REFILL_MS)
            last = now
            ok = tokens >= 1
            if ok:
                tokens -= 1
                passed.add(mark)
        out.append(ok)
    return out, (tokens, last, tuple(sorted(passed)))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decisions over frames in order of user, time and event: one user's bucket is held at a time, so a user of any number of events fits."""
    user, state = None, None
    for frame in frames:
        parts = []
        for key, part in frame.groupby("user_id", sort=False, dropna=False):
            if key != user:
                user, state = key, None
            got, state = admit(zip(part["ms"].tolist(), part["fingerprint"], strict=True), state)
            parts.append(pd.DataFrame({"user_id": part["user_id"], "event_id": part["event_id"], "admitted": got}))
        if parts:
            yield pd.concat(parts)


def _decide(frame: pd.DataFrame, state: tuple | None = None) -> tuple[pd.DataFrame, tuple]:
    frame = frame.sort_values(["ms", "event_id"])
    got, state = admit(zip(frame["ms"].tolist(), frame["fingerprint"], strict=True), state)
    return pd.DataFrame({"user_id": frame["user_id"], "event_id": frame["event_id"], "admitted": got}), state


def gate(events: DataFrame) -> DataFrame:
    """(user_id, event_id, admitted) for events (user_id, event_id, ms, fingerprint), each user's in order of ms and event_id.

    On a table events are sorted by user and time and folded batch by batch, so no user's events are held together; they do
    pass through one task, since each decision needs the one before. On a stream the state of a user is a
    bucket and at most CAP fingerprints, and events are decided by arrival of their micro-batch.
    """
    if not events.isStreaming:
        dealt = events.repartition("user_id").sortWithinPartitions("user_id", "ms", "event_id")
        return dealt.select("user_id", "event_id", "ms", "fingerprint").mapInPandas(_fold, _ROWS)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        start = (held[0], held[1], tuple(held[2])) if held else None
        out, after = _decide(pd.concat(list(frames)), start)
        state.update((after[0], after[1], list(after[2])))
        yield out

    return events.groupBy("user_id").applyInPandasWithState(
        update, _ROWS, "tokens double, last long, seen array<string>", "append", GroupStateTimeout.NoTimeout)
