"""Exact trailing rate limits on a stream, with one ring of timestamps a key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, HOUR = 60_000_000, 3_600_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class TrailingLimits(StatefulProcessor):
    """Per key: events not yet settled, and the times of the settled ones of the last hour.

    An event is settled when the watermark has passed it: then every earlier event of its
    key has arrived, and its counts are final.  A timer stands at the earliest event that
    waits, or an hour after the last one, when the key's state goes.
    """

    def __init__(self, key: str, id_col: str, id_type: str, per_minute: int, per_hour: int):
        self._key, self._id, self._id_type = key, id_col, id_type
        self._per_minute, self._per_hour = per_minute, per_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("ring", f"recent array<long>, waiting array<long>, ids array<{self._id_type}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        recent, waiting, ids = self._state.get() if self._state.exists() else ([], [], [])
        waiting, ids = list(waiting), list(ids)
        for part in rows:
            waiting += part["at_micros"].tolist()
            ids += part[self._id].tolist()
        self._state.update((list(recent), waiting, ids))
        self._handle.registerTimer(min(waiting) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self._state.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        recent, waiting, ids = self._state.get()
        order = np.argsort(np.array(waiting, np.int64), kind="stable")
        at = np.array(waiting, np.int64)[order]
        done = int(np.searchsorted(at, mark, "left"))
        times = np.concatenate([np.array(recent, np.int64), at[:done]])
        left = [ids[k] for k in order[done:]]
        keep = times[times > mark - HOUR]
        if len(left) or len(keep):
            self._state.update((keep.tolist(), at[done:].tolist(), left))
            self._handle.registerTimer(int(at[done]) // 1000 + 1 if len(left) else int(keep[-1] + HOUR) // 1000 + 1)
        else:
            self._state.clear()
        before = np.searchsorted(times, at[:done], "left")
        within = lambda width: before - np.searchsorted(times, at[:done] - width, "right")
        minute, hour = within(MINUTE), within(HOUR)
        over = np.flatnonzero((minute >= self._per_minute) | (hour >= self._per_hour))
        if len(over):
            yield pd.DataFrame(
                {
                    self._key: [key[0]] * len(over),
                    self._id: [ids[k] for k in order[over]],
                    "last_minute": minute[over],
                    "last_hour": hour[over],
                    "retry_after": np.where(minute[over] >= self._per_minute, 60, 3600).astype(np.int32),
                }
            )

    def close(self) -> None:
        pass


def rate_limited_stream(
    events: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", per_minute: int = 60, per_hour: int = 1000, lateness: str = "10 minutes"
) -> DataFrame:
    """Events that find their key over its minute or hour limit, as ``windows.rate_limited`` has them.

    An event comes out once the watermark (the newest event less ``lateness``) has passed
    it; one that arrives behind the watermark is dropped.  A key's state holds its events
    of the last hour and those that wait.  Start the query inside ``state_on_disk``.
    """
    types = dict(events.dtypes)
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, lateness).select(key, id_col, ts, F.unix_micros(ts).alias("at_micros"))
    processor = TrailingLimits(key, id_col, types[id_col], per_minute, per_hour)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{key} {types[key]}, {id_col} {types[id_col]}, last_minute long, last_hour long, retry_after int",
        outputMode="append",
        timeMode="EventTime",
    )
