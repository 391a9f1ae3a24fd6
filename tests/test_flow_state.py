"""The keyed state against fakes of Spark's state: order, late rows, and reads that don't grow with the rows a flow keeps."""

import random

import pandas as pd

from tidewatch.functions.params import Params
from tidewatch.streaming.flows import FlowProcessor


class Map(dict):
    reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


class Handle:
    def __init__(self):
        self.map, self.timers = Map(), []

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, ms):
        self.timers.append(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def rows(minutes):
    return pd.DataFrame([{"t": pd.Timestamp(m * 60, unit="s"), "increase_pct": float(m % 90), "robust_z": m % 5 / 1.0, "moderate": m % 2, "is_timeout": 0, "loss_pct": 0.0, "jitter_ratio": 1.0} for m in minutes])


def started(p):
    flow, handle = FlowProcessor(p), Handle()
    flow.init(handle)
    return flow, handle


def test_reads_per_row_do_not_grow():
    """The watermark stands still, so every row is kept: the last thousand cost what the first did."""
    flow, handle = started(Params())
    cost = []
    for k in range(5):
        before = handle.map.reads
        for m in range(k * 1000, (k + 1) * 1000):
            list(flow.handleInputRows(("a",), iter([rows([m * 4])]), Mark(0)))
        cost.append(handle.map.reads - before)
    assert len(handle.map) == 5000 and max(cost[1:]) == min(cost[1:]) <= 1000 * 12


def test_rows_leave_and_any_order_gives_the_same_state():
    p = Params()
    minutes = list(range(0, 4000, 4))
    flow, handle = started(p)
    kept, said = [], {"predicted": 0, "verified": 0, "expired": 0}
    rng = random.Random(1)
    for i in range(0, len(minutes), 5):
        some = minutes[i : i + 5]
        rng.shuffle(some)  # late rows within the watermark's delay
        for m in some:
            (out,) = flow.handleInputRows(("a",), iter([rows([m])]), Mark(max(0, (minutes[i] - 30) * 60_000)))
            for kind in out["kind"]:
                said[kind] += 1
        kept.append(len(handle.map))
    assert max(kept) < 30  # some rows in the delay, those that wait, and a window
    (out,) = flow.handleExpiredTimer(("a",), Mark(10**9), None)
    said["verified"] += (out["kind"] == "verified").sum()
    said["expired"] += (out["kind"] == "expired").sum()
    assert said == {"predicted": 1000, "verified": 997, "expired": 3}
    assert len(handle.map) == p.window - 1 and flow.cursor is None
    order = sorted(handle.map)
    assert [handle.map[k][-2:] for k in order] == [(order[i - 1][0] if i else None, order[i + 1][0] if i + 1 < len(order) else None) for i in range(len(order))]
