"""Connected components against a plain union of sets, with hubs."""

import random

from pyspark.sql import functions as F

from tidewatch.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(x, find(x)) for x in root if find(x) != x}


def graph(kind):
    rnd = random.Random(kind)
    star = rnd.sample(range(-5_000, 5_000), 600)
    edges = {
        "least": [(-9_000, x) for x in star],
        "greatest": [(x, 9_000) for x in star],
        "middle": [(0, x) for x in star],
        "two": [(-9_000, x) for x in star[:300]] + [(9_000, x) for x in star[299:]],
        "chain": [(x, y) for x, y in zip(star, star[1:])],
        "pieces": [(rnd.randrange(2_000), rnd.randrange(2_000)) for _ in range(700)] + [(9_000, x) for x in range(0, 2_000, 5)],
    }[kind]
    return edges + rnd.choices(edges, k=50) + [(7, 7), (None, 3), (4, None), (-20_000, -20_001)]


def test_equals_plain_union(spark, monkeypatch):
    for hub in (components.HUB, 40):
        monkeypatch.setattr(components, "HUB", hub)
        for kind in ("least", "greatest", "middle", "two", "chain", "pieces"):
            edges = graph(kind)
            got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
            assert {(r.node, r.component) for r in got} == plain(edges) and len(got) == len(plain(edges)), kind
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_node_of_a_million_edges(spark, monkeypatch):
    """The hub is the greatest node; a tail hangs on one of its neighbours."""
    hub, n = 10_000_000, 1_000_000
    seen = []
    plain_hubs = components._hubs
    monkeypatch.setattr(components, "_hubs", lambda both, k: seen.append(plain_hubs(both, k)) or seen[-1])
    star = spark.range(1, n + 1).select(F.col("id").alias("a"), F.lit(hub).cast("long").alias("b"))
    tail = spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 5, n + 6)], "a long, b long")
    found = components.connected_components(star.unionByName(tail))
    assert {(r.component, r.n) for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(1, n + 2), (n + 5, 1)}
    assert seen[0] == [hub]


def test_the_edges_of_hubs_are_not_shuffled_for_their_join(spark):
    both = spark.range(1_000).select((F.col("id") % 3).alias("u"), F.col("id").alias("v"))
    plan = components._with_least(both, [1])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    got = components._with_least(both, [1]).groupBy("u", "m").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 334), (1, 1, 333), (2, 2, 333)]
