"""Long flows: exact quantiles by parts, equal to plain ones, with a flow's values in many tasks."""

import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import baseline as B

SCHEMA = "flow_id string, route string, rtt double, jitter double, loss_pct double"


def lines(rows):
    found = {}
    for r in B.described(rows).collect():
        found[r.flow_id, r.route] = tuple(r)[2:]
    return found


@pytest.mark.parametrize("long_flow,small", [(0, 0), (150, 0), (10**9, 1 << 60)])
def test_all_ways_equal_plain_python(spark, monkeypatch, long_flow, small):
    """All flows by parts, some, none: ties, few values, one value, none, null keys."""
    monkeypatch.setattr(B, "LONG_FLOW", long_flow)
    monkeypatch.setattr(B, "SMALL_BYTES", small)
    rng, rows = random.Random(5), []
    for flow, n, draw in (("a", 400, lambda: rng.gauss(9, 2)), ("b", 200, lambda: rng.choice([1.0, 2.0])), ("c", 1, lambda: 7.0), ("d", 5, lambda: None), (None, 100, lambda: rng.random() * 1e9), ("e", 2, lambda: -rng.random())):
        rows += [(flow, None if flow == "c" else "r", draw() if rng.random() < 0.9 else None, rng.choice([None, 0.5, 1.5]), float(rng.randint(0, 3))) for _ in range(n)]
    want = {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        rtt, jitter, loss = (sorted(r[i] for r in own if r[i] is not None) for i in (2, 3, 4))
        middle = median(rtt) if rtt else None
        iqr = float(np.quantile(rtt, 0.75) - np.quantile(rtt, 0.25)) if rtt else None
        mad = median(abs(x - middle) for x in rtt) if rtt else None
        want[key] = (len(own), len(rtt), middle, iqr, mad, median(jitter) if jitter else None, median(loss) if loss else None, len(rtt) / len(own))
    got = lines(spark.createDataFrame(rows, SCHEMA))
    assert got.keys() == want.keys()
    for key, w in want.items():
        for x, y in zip(got[key], w):
            assert (x is None) == (y is None) and (y is None or x == pytest.approx(y, rel=1e-9, abs=1e-12)), key


def test_flow_of_millions_of_values(spark, monkeypatch):
    """No part of the flow holds more than a small share of it, and the statistics are exact."""
    monkeypatch.setattr(B, "SMALL_BYTES", 0)
    n = 4_000_000
    # A permutation of 0..n-1, squeezed so that values crowd at one end.
    value = F.expr(f"pow((id * 7919) % {n}, 2) / {n}")
    rows = spark.range(n, numPartitions=8).select(F.lit("f").alias("flow_id"), F.lit("r").alias("route"), value.alias("rtt"), F.lit(None).cast("double").alias("jitter"), (F.col("id") % 2).cast("double").alias("loss_pct"))
    r = lines(rows)["f", "r"]
    exact = np.arange(n, dtype=np.float64) ** 2 / n
    middle = np.quantile(exact, 0.5)
    assert r[:2] == (n, n) and r[5] is None and r[6] == 0.5
    assert r[2:5] == pytest.approx((middle, np.quantile(exact, 0.75) - np.quantile(exact, 0.25), np.quantile(abs(exact - middle), 0.5)), rel=1e-9)
    values = rows.select("flow_id", F.col("rtt").alias("value"))
    dealt = values.join(B.value_cuts(values, ("flow_id",)), "flow_id").groupBy(B._part_of(F.col("value"), F.col("rough"), F.col("fine")).alias("part")).count()
    largest = dealt.agg(F.max("count")).first()[0]
    assert largest < n / 100
