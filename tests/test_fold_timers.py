"""The state of an ordered fold: one timer for a batch of rows of a key, and each waiting row read once per watermark."""

import pandas as pd

from lodestar.operators.stateful import OrderedFold


class Held:
    def __init__(self):
        self.v, self.reads = None, 0

    def exists(self):
        return self.v is not None

    def get(self):
        self.reads += 1
        return iter(self.v) if isinstance(self.v, list) else self.v

    def put(self, v):
        self.v = v

    update = put

    def appendList(self, v):
        self.v = (self.v or []) + v

    def clear(self):
        self.v = []


class Handle:
    def __init__(self):
        self.timers, self.rows, self.numbers = [], Held(), Held()

    def getListState(self, *_):
        return self.rows

    def getValueState(self, *_):
        return self.numbers

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_batch_of_rows_sets_one_timer_and_is_folded_in_order():
    h, fold = Handle(), OrderedFold((0.0,), lambda s, t, v: ((s[0] + (v or 0),), s[0] + (v or 0)))
    fold.init(h)
    rows = pd.DataFrame({"id": range(25_000), "t": [(25_000 - k) * 1000 for k in range(25_000)], "value": [None if k == 24_999 else 1.0 for k in range(25_000)]})
    list(fold.handleInputRows((1,), iter([rows[:9000], rows[9000:]]), Clock(0)))
    assert h.timers == [1]
    first = pd.concat(fold.handleExpiredTimer((1,), Clock(15_000), Clock(1)))
    assert first["id"].tolist() == list(range(24_999, 9_999, -1)) and first["result"].tolist() == [float(k) for k in range(15_000)]
    assert h.timers == [1, 15_001] and h.rows.reads == 1
    rest = pd.concat(fold.handleExpiredTimer((1,), Clock(10**6), Clock(15_001)))
    assert rest["id"].tolist() == list(range(9_999, -1, -1)) and rest["result"].iloc[-1] == 24_999 and list(h.rows.get()) == []
    assert list(fold.handleExpiredTimer((1,), Clock(10**6), Clock(15_001))) == []
