"""The bootstrap interval against a plain one that draws the same numbers."""

import hashlib
import random

import pytest

from tidewatch.functions.params import CLASSES
from tidewatch.operators import evaluate as E
from tidewatch.plans import registry


def share(a, b):
    return a / b if b else 0.0


def macro(rows, i):
    total = 0.0
    for c in CLASSES:
        hit, said, support = sum(r[0] == c == r[i] for r in rows), sum(r[i] == c for r in rows), sum(r[0] == c for r in rows)
        p, r = share(hit, said), share(hit, support)
        total += share(2 * p * r, p + r)
    return total / len(CLASSES)


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("flows,chunk", [(1, 4096), (5, 4096), (150, 2)])
def test_equals_plain_bootstrap(spark, flows, chunk):
    rnd = random.Random(flows)
    said = [*CLASSES, None]
    rows = [(f"f{i}", rnd.choice([*CLASSES, None]), rnd.choice(said), rnd.choice(said)) for i in range(flows) for _ in range(rnd.randint(1, 4))]
    rows.append(("f0", "OK", "OK", "RISK"))
    by_flow = {}
    for k, *r in rows:
        if r[0] is not None:
            by_flow.setdefault(k, []).append(r)
    keys, diffs = sorted(by_flow), []
    for b in range(40):
        drawn = [keys[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % len(keys)] for i in range(len(keys))]
        taken = [r for k in drawn for r in by_flow[k]]
        diffs.append(macro(taken, 1) - macro(taken, 2))
    df = spark.createDataFrame(rows, "flow_id string, status_future string, a string, b string")
    got = E.bootstrap_ci(df, "a", "b", 40, chunk=chunk).first()
    assert got.resamples == 40
    assert (got.low, got.high) == (pytest.approx(quantile(diffs, 0.025)), pytest.approx(quantile(diffs, 0.975)))


def test_flows_are_numbered_in_order(spark):
    keys = [f"k{i * 7919 % 1000}" for i in range(1000)]
    got = E.flow_counts(spark.createDataFrame([(k, "OK") for k in keys], "flow_id string, status_future string"), {}).collect()
    assert sorted((r.flow_id, r._no) for r in got) == [(k, i) for i, k in enumerate(sorted(keys))]


def test_registered_with_all_resamples(spark):
    assert registry.QUERIES["a22_bootstrap"](spark, "/root/testdata/sf0.001").first().resamples == 2_000
