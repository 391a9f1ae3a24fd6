"""Thresholds, windows and names.  The defaults are the fixed values of the rule table."""

from __future__ import annotations

from dataclasses import dataclass

#: Classes in their order of severity.
OK, RISK, FAIL = "OK", "RISK", "FAIL"
CLASSES = (OK, RISK, FAIL)

BASELINE_COLUMNS = ("median", "mad", "iqr", "jitter_typical")
#: Columns that a model may see, those that some models add, and those that none may see.
MODEL_COLUMNS = ("robust_z", "increase_pct", "jitter_ratio", "loss_pct", "is_timeout", "n5_timeout", "n5_increase80", "n5_moderate")
EXTRA_COLUMNS = ("min5_z", "mean5_z")
HIDDEN_COLUMNS = ("flow_id", "route", "region", "t", "rtt", "jitter", "period", "latency_ratio", "moderate", "deviated", "trend", "persistence", "rule", "status_now", "status_future", "block", "t_future")


@dataclass(frozen=True)
class Params:
    window: int = 5
    horizon: int = 3
    baseline_hours: int = 108
    min_valid: int = 1500
    gate: tuple[int, int] = (600, 840)
    loss_fail: float = 10.0
    z_risk: float = 2.0
    z_fail: float = 3.5
    increase_risk: float = 30.0
    increase_fail: float = 80.0
    jitter_risk: float = 3.0
    #: Increase that rule 3 also asks for; None: z alone.
    floor: float | None = 30.0
    timeouts_fail: int = 3
    increases_fail: int = 2
    moderates_risk: int = 2
    mad_factor: float = 1.4826
    iqr_factor: float = 1.349
    min_scale: float = 1.0
    zero_jitter_ratio: float = 3.0
    splits: tuple[float, float] = (0.5, 0.7)


#: For series made of events, which are far sparser than probe bursts.
EVENT_PARAMS = Params(baseline_hours=360, min_valid=20, gate=(65_000, 152_000))
#: For bursts made of orders and their lines.
ORDER_PARAMS = Params(baseline_hours=28_800, min_valid=30, gate=(1_000_000, 10_000_000))


@dataclass(frozen=True)
class Band:
    """Values of a column from ``low`` on: up to ``high`` if it is closed, else below it; without ``high`` there is no end."""

    column: str
    low: float
    high: float | None = None
    closed: bool = False


def moderate_bands(p: Params) -> tuple[Band, ...]:
    """One of them makes a measurement moderately deviant."""
    return (
        Band("robust_z", p.z_risk, p.z_fail),
        Band("increase_pct", p.increase_risk, p.increase_fail, closed=True),
        Band("jitter_ratio", p.jitter_risk),
    )


def deviant_bands(p: Params) -> tuple[Band, ...]:
    """One of them makes a measurement deviant at all."""
    return Band("robust_z", p.z_risk), Band("increase_pct", p.increase_risk), Band("is_timeout", 1)


def rule_table(p: Params) -> tuple[tuple[tuple[Band, ...], str], ...]:
    """The rules in their order: bands that must all hold, and the class that the first rule to hold gives.  Batch and stream read it."""
    extreme = (Band("robust_z", p.z_fail),) if p.floor is None else (Band("robust_z", p.z_fail), Band("increase_pct", p.floor))
    return (
        ((Band("loss_pct", p.loss_fail),), FAIL),
        ((Band("n5_timeout", p.timeouts_fail),), FAIL),
        (extreme, FAIL),
        ((Band("n5_increase80", p.increases_fail),), FAIL),
        ((Band("moderate", 1), Band("n5_moderate", p.moderates_risk)), RISK),
    )


#: Features over a flow's last measurements: name, aggregate, column.  Nulls are left out; of nulls only, the result is null.
TRAILING = (
    ("n5_timeout", "sum", "is_timeout"),
    ("n5_increase80", "sum", "large_increase"),
    ("n5_moderate", "sum", "moderate"),
    ("persistence", "avg", "deviated"),
    ("min5_z", "min", "robust_z"),
    ("mean5_z", "avg", "robust_z"),
)

#: The fixed rule that needs no fitted model: the first line whose bands hold says the class, else OK.
FIXED_RULE = (
    ((Band("mean5_z", 3.5),), FAIL),
    ((Band("mean5_z", 2.0),), RISK),
    ((Band("moderate", 1),), RISK),
)


def first_class(table: tuple[tuple[tuple[Band, ...], str], ...], row: dict) -> tuple[int, str]:
    """Number (from 1) and class of the first line whose bands all hold in a row of plain values; one more than their number and OK without one."""

    def holds(b: Band) -> bool:
        x = row[b.column]
        return x is not None and x >= b.low and (b.high is None or (x <= b.high if b.closed else x < b.high))

    return next(((i, says) for i, (bands, says) in enumerate(table, 1) if all(map(holds, bands))), (len(table) + 1, OK))
