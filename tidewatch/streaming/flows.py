"""Keyed state of the live job: a flow's last rows as a linked list, with event-time timers.

Each row of a flow is an entry of a map by its time, and knows the rows before
and after it.  An arriving row is put in place from the newest end, reads the
few rows that its window reaches back, and sets two timers: when the watermark
passes its time, the row some places before it can be judged; when it has passed
the end of its gate, it may expire.  A cursor stands at the oldest row that
still waits; rows that no window needs any more leave at the old end.  So the
cost of a row depends on its window and on how late it is, not on how many rows
the flow keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.params import FIXED_RULE, TRAILING, Params, first_class, rule_table

OUTPUT_SCHEMA = "flow_id string, t timestamp, kind string, n5_timeout long, n5_increase80 long, n5_moderate long, min5_z double, mean5_z double, rule int, status string, prediction string, robust_z double, increase_pct double, jitter_ratio double, loss_pct double, is_timeout int"
KEPT = ("increase_pct", "robust_z", "moderate", "is_timeout", "loss_pct", "jitter_ratio")
_ROW = "increase_pct double, robust_z double, moderate int, is_timeout int, loss_pct double, jitter_ratio double, prediction string, before long, after long"
_FIELDS = (*KEPT, "prediction", "before", "after")
_NOTHING = (None,) * 5


def trailing(window: list[dict], p: Params) -> dict:
    """The trailing features of the last of some rows, from the table that batch reads too."""
    out = {}
    for name, how, column in TRAILING:
        if column == "large_increase":
            values = [int(r["increase_pct"] > p.increase_fail) for r in window if r["increase_pct"] is not None]
        else:
            values = [r[column] for r in window if r.get(column) is not None]
        out[name] = None if not values else min(values) if how == "min" else sum(values) / (len(values) if how == "avg" else 1)
    return out


def judged(window: list[dict], p: Params) -> tuple[int, str, dict]:
    """Rule, class and features of the last row of a window, by the tables of the batch columns."""
    f = trailing(window, p)
    return *first_class(rule_table(p), window[-1] | f), f


class FlowProcessor(StatefulProcessor):
    """Emits kind 'predicted' at arrival, then 'verified' (status: the class that came) or 'expired'."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "us long", _ROW)
        #: Oldest and newest row, the oldest that waits, and how many rows before that one are kept.
        self.ends = handle.getValueState("ends", "oldest long, newest long, cursor long, kept int")

    def close(self) -> None:
        pass

    def _get(self, us: int | None) -> dict | None:
        if us is None:
            return None
        found = self.rows.getValue((us,))
        return dict(zip(_FIELDS, found)) | {"us": us}

    def _put(self, row: dict) -> None:
        self.rows.updateValue((row["us"],), tuple(row[f] for f in _FIELDS))

    def _window(self, row: dict) -> list[dict]:
        """The row and those before it, oldest first."""
        out = [row]
        while len(out) < self.p.window and (before := self._get(out[-1]["before"])) is not None:
            out.append(before)
        return out[::-1]

    def _arrive(self, row: dict) -> None:
        """Puts a row in its place, from the newest end on."""
        before = self._get(self.newest)
        after = None
        while before is not None and before["us"] > row["us"]:
            after, before = before, self._get(before["before"])
        row["before"], row["after"] = before and before["us"], after and after["us"]
        if before is None:
            self.oldest = row["us"]
        else:
            self._put(before | {"after": row["us"]})
        if after is None:
            self.newest = row["us"]
        else:
            self._put(after | {"before": row["us"]})
        if self.cursor is None or row["us"] < self.cursor:
            self.cursor = row["us"]

    def _pass(self, row: dict) -> None:
        """Takes the cursor past a row that waits no longer; the row that no window reaches any more leaves."""
        self.cursor, self.kept = row["after"], self.kept + 1
        while self.kept >= self.p.window:
            first = self._get(self.oldest)
            self.rows.removeKey((self.oldest,))
            self.oldest, self.kept = first["after"], self.kept - 1
            if self.oldest is None:
                self.newest = None
            else:
                self._put(self._get(self.oldest) | {"before": None})

    def _settle(self, flow: str, mark: int) -> Iterator[tuple]:
        """Verified and expired rows, oldest first, as far as the watermark lets them be."""
        while (row := self._get(self.cursor)) is not None:
            ahead = row
            for _ in range(self.p.horizon):
                ahead = ahead and self._get(ahead["after"])
            if ahead is not None and ahead["us"] <= mark:  # no row can come between any more
                gap = ahead["us"] // 1_000_000 - row["us"] // 1_000_000
                ok = self.p.gate[0] <= gap <= self.p.gate[1]
                status = judged(self._window(ahead), self.p)[1] if ok else None
                yield (flow, row["us"], "verified" if ok else "expired", *_NOTHING, None, status, row["prediction"], *_NOTHING)
            elif row["us"] + self.p.gate[1] * 1_000_000 < mark:  # what still comes lies behind the gate
                yield (flow, row["us"], "expired", *_NOTHING, None, None, row["prediction"], *_NOTHING)
            else:
                return
            self._pass(row)

    def _opened(self) -> None:
        self.oldest, self.newest, self.cursor, self.kept = self.ends.get() if self.ends.exists() else (None, None, None, 0)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        self.ends.update((self.oldest, self.newest, self.cursor, self.kept))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])
        frame["t"] = pd.to_datetime(frame["t"], unit="us")
        return frame.astype({"n5_timeout": "Int64", "n5_increase80": "Int64", "n5_moderate": "Int64", "rule": "Int32", "is_timeout": "Int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._opened()
        out = []
        fresh = [r for batch in rows for r in batch.to_dict("records")]
        for r in sorted(fresh, key=lambda r: r["t"]):
            row = {c: None if pd.isna(r[c]) else float(r[c]) for c in KEPT}
            row |= {"us": pd.Timestamp(r["t"]).value // 1000, "moderate": int(r["moderate"]), "is_timeout": int(r["is_timeout"])}
            self._arrive(row)
            rule, status, f = judged(self._window(row), self.p)
            row["prediction"] = first_class(FIXED_RULE, row | f)[1]  # needs no fitting; for a fitted model see predict_on_arrival
            self._put(row)
            for due in (row["us"] // 1000 + 1, row["us"] // 1000 + self.p.gate[1] * 1000 + 1):
                self.handle.registerTimer(due)
            out.append((key[0], row["us"], "predicted", f["n5_timeout"], f["n5_increase80"], f["n5_moderate"], f["min5_z"], f["mean5_z"], rule, status, row["prediction"], *(row[c] for c in ("robust_z", "increase_pct", "jitter_ratio", "loss_pct", "is_timeout"))))
        out += self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._opened()
        yield self._frame(list(self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)))


RECENT_SCHEMA = "flow_id string, newest_hour timestamp, n long, timeouts long, mean_rtt double"


class RecentProcessor(StatefulProcessor):
    """A flow's measurements of the last hours as sums by hour; hours leave when newer ones push them out, or by themselves when the flow falls silent."""

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "hour long", "n long, timeouts long, answered long, total double", ttlDurationMs=(self.hours + 1) * 3_600_000)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            hour = batch["t"].astype("datetime64[us]").astype("int64") // 3_600_000_000
            found = batch.assign(hour=hour).groupby("hour").agg(n=("t", "size"), timeouts=("is_timeout", "sum"), answered=("rtt", "count"), total=("rtt", "sum"))
            for h, *more in found.itertuples():
                old = self.sums.getValue((h,)) or (0, 0, 0, 0.0)
                self.sums.updateValue((h,), tuple(kind(a + b) for kind, a, b in zip((int, int, int, float), old, more)))
        held = {h: v for (h,), v in self.sums.iterator()}  # no more hours than the view has, and those of this batch
        newest = max(held)
        for h in [h for h in held if h <= newest - self.hours]:
            self.sums.removeKey((h,))
            del held[h]
        n, timeouts, answered, total = (sum(v[i] for _, v in sorted(held.items())) for i in range(4))
        at = pd.to_datetime([newest * 3_600_000_000], unit="us")
        yield pd.DataFrame({"flow_id": [key[0]], "newest_hour": at, "n": [n], "timeouts": [timeouts], "mean_rtt": [total / answered if answered else None]}).astype({"mean_rtt": "float64"})
