"""Rules over event time with state by key: rows wait until the watermark has passed them, so that rows that come late
and in any order give what an ordered batch gives; timers act without input; state that can't matter any more is freed.

A key stands for many users or entries, whose numbers are arrays in its state: what a rule costs is what its rows cost,
not a call for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NOBODY = -1  # the bucket of rows that only move time on


def _packed(*columns) -> tuple[bytes]:
    return (np.array(columns, np.int64).tobytes(),)


def _unpacked(chunks, columns: int) -> np.ndarray:
    """(columns, rows) of packed chunks."""
    found = [np.frombuffer(c[0], np.int64).reshape(columns, -1) for c in chunks]
    return np.concatenate(found, axis=1) if found else np.zeros((columns, 0), np.int64)


class Throttle(StatefulProcessor):
    """Of each user's rows (user_id, at, event_id) lets through those ``limit`` microseconds or more after the last one let through; the key is a bucket of users."""

    OUTPUT = "user_id long, event_id long"

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "packed binary")  # user_id, at
        self.waiting = handle.getListState("waiting", "packed binary")  # user_id, at, event_id

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [_packed(r["user_id"], r["at"], r["event_id"]) for r in rows]
        if key[0] != NOBODY:
            self.waiting.appendList(new)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = _unpacked(self.waiting.get() if self.waiting.exists() else (), 3)
        last = dict(_unpacked([self.last.get()] if self.last.exists() else (), 2).T.tolist())
        due = waiting[1] <= now * 1000
        user, at, event = waiting[:, due]
        order = np.lexsort((event, at))
        kept = []
        for u, a, e in zip(user[order].tolist(), at[order].tolist(), event[order].tolist(), strict=True):
            before = last.get(u)
            if before is None or a - before >= self.limit:
                last[u] = a
                kept.append((u, e))
        rest = waiting[:, ~due]
        last = {u: a for u, a in last.items() if now * 1000 - a < self.limit}  # the next row of others goes through whatever is known
        if rest.size:
            self.waiting.put([_packed(*rest)])
        else:
            self.waiting.clear()
        if last:
            self.last.update(_packed(list(last), list(last.values())))
        else:
            self.last.clear()
        if rest.size:
            self.handle.registerTimer(now + 1)
        elif last:
            self.handle.registerTimer(max(now + 1, -(-(max(last.values()) + self.limit) // 1000)))
        return iter([pd.DataFrame(kept, columns=["user_id", "event_id"], dtype="int64")] if kept else ())

    def close(self) -> None:
        pass


class CacheAges(StatefulProcessor):
    """Counts a key's entries (at) that are live, stale and expired whenever the watermark moves; expired ones leave the state."""

    OUTPUT = "event_type string, shard int, now_ms long, live long, stale long, expired long"

    def __init__(self, ttl: int, refresh: int):
        self.ttl, self.refresh = ttl, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "packed binary")  # at
        self.gone = handle.getValueState("gone", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [_packed(r["at"]) for r in rows]
        if not pd.isna(key[0]):
            self.entries.appendList(new)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        gone = self.gone.get()[0] if self.gone.exists() else 0
        at = _unpacked(self.entries.get() if self.entries.exists() else (), 1)[0]
        age = now // 1000 - at // 1_000_000
        rest = at[age <= self.ttl]
        gone += len(at) - len(rest)
        due = (age <= self.ttl) & (at // 1000 <= now)  # later ones are waiting to be due
        stale = int((due & (age > self.refresh)).sum())
        self.gone.update((gone,))
        if len(rest):
            self.entries.put([_packed(rest)])
            self.handle.registerTimer(now + 1)
        else:
            self.entries.clear()
        row = {"event_type": key[0], "shard": int(key[1]), "now_ms": now, "live": int(due.sum()) - stale, "stale": stale, "expired": gone}
        return iter([pd.DataFrame([row])])

    def close(self) -> None:
        pass
