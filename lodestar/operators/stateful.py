"""Streams with state of their own per key: rows are held until the watermark has passed them and are then folded in the order of time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Folds each key's rows (id, t in microseconds, value) by (t, id) as soon as no earlier row can come.

    `step(state, t, value)` gives the new state, numbers as many as in `start`, and the row's result. Rows wait in a list state, a batch of them as one
    entry of packed numbers, with a timer at the least time of those that wait; when it fires, all rows that the watermark has passed are folded in one go. The state of a key is these
    waiting rows and the numbers.
    """

    def __init__(self, start: tuple[float, ...], step: Callable[[tuple, int, float], tuple[tuple, float]]):
        self.start, self.step = start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ids binary, times binary, vals binary")
        self.numbers = handle.getValueState("numbers", "at long, " + ", ".join(f"n{k} double" for k in range(len(self.start))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries, least = [], None
        for part in rows:
            ids, times, vals = part["id"].to_numpy("int64"), part["t"].to_numpy("int64"), part["value"].to_numpy("float64")
            if len(ids):
                entries.append((ids.tobytes(), times.tobytes(), vals.tobytes()))
                least = min(int(times.min()), least if least is not None else int(times.min()))
        if entries:
            self.waiting.appendList(entries)
            self.handle.registerTimer(math.ceil(least / 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # rows up to the watermark come no more
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        ready, later = [], []
        for entry in self.waiting.get():
            part = (np.frombuffer(entry[0], "int64"), np.frombuffer(entry[1], "int64"), np.frombuffer(entry[2], "float64"))
            now = part[1] <= upto
            ready.append([v[now] for v in part])
            if not now.all():
                later.append([v[~now] for v in part])
        ids, times, vals = (np.concatenate(v) for v in zip(*ready)) if ready else (np.zeros(0),) * 3
        if not len(ids):
            return
        if later:
            self.waiting.put([tuple(v.tobytes() for v in part) for part in later])
            self.handle.registerTimer(math.ceil(min(int(part[1].min()) for part in later) / 1000))
        else:
            self.waiting.clear()
        order = np.lexsort((ids, times))
        at, *state = self.numbers.get() if self.numbers.exists() else (int(times[order[0]]), *self.start)
        state = tuple(state)
        for lo in range(0, len(order), 10_000):
            some, out = order[lo:lo + 10_000], []
            for t, v in zip(times[some].tolist(), vals[some].tolist()):
                state, result = self.step(state, t - at, None if v != v else v)
                at = t
                out.append(result)
            yield pd.DataFrame({"key": [key[0]] * len(some), "id": ids[some], "result": pd.Series(out, dtype="float64")})
        self.numbers.update((at, *state))

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key: str, ts: str, row_id: str, value: str, late: str, start: tuple[float, ...], step) -> DataFrame:
    """(key, id, result) of a stream: each key's rows folded in the order of time and id. Rows later than `late` are dropped; rows without key, time or id take no part. The session must keep its state in RocksDB (see ROCKS)."""
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(row_id).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.col(row_id).cast("long").alias("id"), F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("value"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(OrderedFold(start, step), "key long, id long, result double", "Append", "eventTime")


def token_step(capacity: float, per_second: float):
    """A bucket of tokens that fills over time: the result is 1 where a row takes a token, else 0."""
    def step(state, elapsed, value):
        level = min(capacity, state[0] + elapsed / 1e6 * per_second)
        return (level - (level >= 1),), float(level >= 1)

    return step


def score_step(state, elapsed, value):
    """A running model of a key's values (count, mean, squared differences): the result is how many deviations a value lies from those before it, null while there are fewer than two different ones."""
    n, mean, m2 = state
    if value is None:
        return state, None
    sd = math.sqrt(m2 / n) if n else 0.0
    score = (value - mean) / sd if sd > 0 else None
    n += 1
    gap = value - mean
    mean += gap / n
    return (n, mean, m2 + gap * (value - mean)), score
