"""One softmax ensemble: against plain Python, against one-vs-rest, missing values, edge tables, saved and loaded."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import boosting as B
from tidewatch.operators import models as ML
from tidewatch.operators.labels import usable_rows
from tidewatch.plans.registry import Chain


def plain_fit(rows, edges, n_classes, rounds, depth, rate, ridge, least):
    """The same boosting by loops over rows: returns a function from a row's values to its margins."""
    place = lambda x, cuts: 0 if x is None else 1 + sum(c < x for c in cuts)
    bins = [[place(x, cuts) for x, cuts in zip(values, edges)] for values, _, _ in rows]
    margins = [[0.0] * n_classes for _ in rows]
    forest = []
    for _ in range(rounds):
        probs = [[math.exp(m) / sum(map(math.exp, ms)) for m in ms] for ms in margins]
        stage = []
        for k in range(n_classes):
            g = [round(w * (p[k] - (y == k)) * B.UNIT) / B.UNIT for p, (_, y, w) in zip(probs, rows)]
            h = [round(w * 2 * p[k] * (1 - p[k]) * B.UNIT) / B.UNIT for p, (_, y, w) in zip(probs, rows)]

            def grow(members, level):
                total = sum(g[i] for i in members), sum(h[i] for i in members)
                if level == depth:
                    return -total[0] / (total[1] + ridge) * rate
                best = (1e-9, None)
                for c in range(len(edges)):
                    for missing_left in (False, True):
                        for cut in range(1, len(edges[c]) + 2):
                            left = {i for i in members if (missing_left if bins[i][c] == 0 else bins[i][c] <= cut)}
                            a = sum(g[i] for i in left), sum(h[i] for i in left)
                            b = total[0] - a[0], total[1] - a[1]
                            if a[1] >= least and b[1] >= least:
                                gain = a[0] ** 2 / (a[1] + ridge) + b[0] ** 2 / (b[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                                if gain > best[0] + 1e-12:
                                    best = (gain, (c, missing_left, cut))
                if best[1] is None:
                    return grow(members, level + 1)
                c, missing_left, cut = best[1]
                left = [i for i in members if (missing_left if bins[i][c] == 0 else bins[i][c] <= cut)]
                return best[1], grow(left, level + 1), grow([i for i in members if i not in set(left)], level + 1)

            stage.append(grow(list(range(len(rows))), 0))
        forest.append(stage)

        def reach(tree, b):
            while isinstance(tree, tuple):
                (c, missing_left, cut), yes, no = tree
                tree = yes if (missing_left if b[c] == 0 else b[c] <= cut) else no
            return tree

        for i, b in enumerate(bins):
            margins[i] = [m + reach(t, b) for m, t in zip(margins[i], stage)]
    return margins


def test_equals_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        values = [rng.choice([None, rng.gauss(0, 1)]) if rng.random() < 0.2 else round(rng.gauss(0, 1), 1) for _ in range(3)]
        y = int((values[0] or 0) + (values[1] if values[1] is not None else 1) > 0.3) + int((values[2] or 0) > 0.8)
        rows.append((values, y, rng.choice([1.0, 2.0])))
    df = spark.createDataFrame([(*v, float(y), w) for v, y, w in rows], "a double, b double, c double, label double, weight double")
    settings = {"rounds": 3, "depth": 2, "rate": 0.3, "ridge": 1.0, "least": 2.0}
    model = B.fit_softmax(df.repartition(3), ("a", "b", "c"), bins=6, **settings)
    want = B.softmax(np.array(plain_fit(rows, [e.tolist() for e in model.edges], 3, **settings)))
    got = model.probabilities(np.array([[np.nan if x is None else x for x in v] for v, _, _ in rows]))
    assert abs(got - want).max() < 1e-6
    scored = model.transform(df).collect()
    assert abs(np.array([r.probability for r in scored]) - got).max() < 1e-12
    assert all(r.prediction == np.argmax(p) for r, p in zip(scored, got))
    again = B.fit_softmax(df.repartition(5), ("a", "b", "c"), bins=6, **settings)
    assert (again.trees.value == model.trees.value).all() and (again.trees.column == model.trees.column).all()


@pytest.fixture(scope="module")
def blocks(spark):
    ready = ML.prepare(usable_rows(Chain(spark, "/root/testdata/sf0.01").blk, 3), ML.ALL_COLUMNS).cache()
    return ready.where("block = 'train'"), ready.where("block = 'validation'")


def test_better_than_one_against_the_rest(blocks):
    """Mean log loss on the validation block, where one-vs-rest gives scores that are made to sum to 1."""
    train, validation = blocks
    model = ML.fit_boost(train, rounds=12, depth=3)
    scored = model.transform(validation)
    sums = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    own = B.log_loss(scored).first().log_loss
    rest = ML.fit_one_vs_rest(train, rounds=5, depth=3)
    raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
    theirs = rest.transform(validation).withColumn("probability", raw)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    assert own < B.log_loss(theirs.withColumn("probability", F.transform("probability", lambda x: x / total))).first().log_loss


def test_margins_are_carried_on_and_models_kept(spark, blocks, tmp_path, monkeypatch):
    train, validation = blocks
    model = ML.fit_boost(train, rounds=5, depth=2)
    monkeypatch.setattr(B, "STEP", 2)
    other = ML.fit_boost(train, rounds=5, depth=2)
    assert abs(other.trees.value - model.trees.value).max() < 1e-9
    model.save(spark, f"{tmp_path}/model")
    loaded = B.SoftmaxBoost.load(spark, f"{tmp_path}/model")
    assert loaded.cols == model.cols and (loaded.trees.value == model.trees.value).all()
    assert ML.round_trip(model, validation, f"{tmp_path}/again").count() == 0
    importance = {r["column"]: r.importance for r in ML.importances(model, ML.ALL_COLUMNS, "boost", train).collect()}
    assert set(importance) == set(ML.ALL_COLUMNS) and abs(sum(importance.values()) - 1) < 1e-9


def test_edge_tables(spark):
    """No rows, one class only, a column of nulls, NaN as missing, rows without a label."""
    kind = "a double, b double, label double, weight double"
    none = B.fit_softmax(spark.createDataFrame([], kind), ("a", "b"), rounds=2, depth=2)
    assert abs(none.probabilities(np.array([[1.0, np.nan]])) - 1 / 3).max() < 1e-12
    rows = [(float("nan") if i % 2 else None, None, 1.0, 1.0) for i in range(40)] + [(1.0, None, None, 1.0), (1.0, None, 0.0, None)]
    one = B.fit_softmax(spark.createDataFrame(rows, kind), ("a", "b"), rounds=8, depth=2)
    p = [r.probability for r in one.transform(spark.createDataFrame([(5.0, 1.0), (None, None)], "a double, b double")).collect()]
    assert p[0] == p[1] and p[0][1] > 0.9
