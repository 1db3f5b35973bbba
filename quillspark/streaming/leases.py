"""Leases as a stream: requests that come late or twice are judged in the order of their time, and leases end by timers.

A request waits in its key's state until the watermark has passed its time, so that all earlier ones are there; a timer then calls for it. So the decisions are those of a batch over all
rows, whatever the micro-batches. The state of a key is its waiting requests, the end of its lease, and the grants of the window; it empties itself as timers fire.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "id long, at timestamp, outcome string"


class Leases(StatefulProcessor):
    """One lease a key at a time, `hold` seconds long, `most` in `window` seconds."""

    def __init__(self, key: str, hold: int, most: int, window: int):
        self.key, self.hold, self.most, self.window = key, hold * 1_000_000, most, window * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.lease = handle.getValueState("lease", "until long, id long")
        self.grants = handle.getListState("grants", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = frame["at"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(times.tolist(), frame["id"].tolist(), strict=True)))
            for ms in sorted({-(-t // 1000) for t in times.tolist()}):
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= now]
        grants = [g[0] for g in self.grants.get()] if self.grants.exists() else []
        lease = tuple(self.lease.get()) if self.lease.exists() else None
        out = []
        for at, id_ in [*due, (now, None)]:
            if lease and lease[0] <= at:
                out.append((lease[1], lease[0], "expired"))
                lease = None
            if id_ is None:
                break
            grants = [g for g in grants if g > at - self.window]
            outcome = "active" if lease else "rate" if len(grants) >= self.most else "granted"
            if outcome == "granted":
                grants.append(at)
                lease = (at + self.hold, id_)
                self.handle.registerTimer(-(-lease[0] // 1000))
            out.append((id_, at, outcome))
        for state, values in ((self.waiting, waiting[len(due) :]), (self.grants, [(g,) for g in grants if g > now - self.window])):
            state.put(values) if values else state.clear()
        self.lease.update(lease) if lease else self.lease.clear()
        if out:
            frame = pd.DataFrame(out, columns=["id", "at", "outcome"])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            frame.insert(0, self.key, key[0])
            yield frame

    def close(self) -> None:
        pass


def leases(requests: DataFrame, key: str, at: str, id_: str, hold: int, most: int, window: int, late: str) -> DataFrame:
    """key, id, at, outcome of a stream of requests: granted, active (a lease is open) or rate (`most` grants in the window), and expired, at its end, for each lease that was granted.
    Requests more than `late` behind are dropped, repeated ones (key and id) count once. Needs the RocksDB state store."""
    once = requests.select(F.col(key), F.col(at).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id")).withWatermark("at", late).dropDuplicatesWithinWatermark([key, "id"])
    return once.groupBy(key).transformWithStateInPandas(Leases(key, hold, most, window), f"`{key}` {dict(requests.dtypes)[key]}, {OUT}", "Append", "EventTime")
