import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import audits as U
from tidewatch.operators import evaluate as E
from tidewatch.operators import models as ML
from tidewatch.operators.labels import usable_rows
from tidewatch.plans import registry
from tidewatch.plans.registry import Chain
from tidewatch.sources import adapters

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def blocks(spark):
    rows = usable_rows(Chain(spark, SF).blk, 3).cache()
    ready = ML.prepare(rows, ML.ALL_COLUMNS)
    return rows, ready.where("block = 'train'"), ready.where("block = 'validation'")


def test_tree_profile_round_trip_and_importance(blocks, tmp_path):
    rows, train, validation = blocks
    model = ML.fit_tree(train, depth=4)
    scored = ML.score(model, validation, "tree-1")
    assert {r.model_pred for r in scored.collect()} <= {"OK", "RISK", "FAIL"}
    assert all(abs(r.p_ok + r.p_risk + r.p_fail - 1) < 1e-9 for r in scored.limit(50).collect())
    profile = ML.leaf_profile(scored).collect()
    assert sum(r.n for r in profile) == validation.count() and all(0 < r.purity <= 1 for r in profile)
    assert ML.round_trip(model, validation, f"{tmp_path}/tree").count() == 0
    total = sum(r.importance for r in ML.importances(model, ML.ALL_COLUMNS, "tree", train).collect())
    assert abs(total - 1) < 1e-6
    missing = rows.limit(1).selectExpr("flow_id", "t", *(f"CAST(NULL AS DOUBLE) AS {c}" for c in ML.ALL_COLUMNS))
    assert ML.score(model, ML.assemble(missing, ML.ALL_COLUMNS), "tree-1").count() == 1


def test_grid_and_families(blocks):
    _, train, validation = blocks
    table = ML.grid(ML.fit_tree, {"depth": [2, 4], "min_rows": [20]}, train, validation).collect()
    assert len(table) == 2 and all(abs(r.gap - (r.f1_train - r.f1_validation)) < 1e-12 for r in table)
    for r in table:
        by_hand = ML.fit_tree(train, depth=r.depth, min_rows=20)
        for part, got in ((train, r.f1_train), (validation, r.f1_validation)):
            cm = E.confusion(ML.score(by_hand, part, "m"), "status_future", "model_pred")
            assert abs(E.summary_metrics(cm).first().macro_f1 - got) < 1e-9
    forest = ML.fit_forest(train, trees=5, depth=4)
    boost = ML.fit_boost(train, rounds=3, depth=2)
    out = ML.compare_models({"forest": ML.score(forest, validation, "f"), "boost": ML.score(boost, validation, "b")}).collect()
    assert [r.model for r in out] == ["forest", "boost"] and all(0 < r.macro_f1 < 1 for r in out)


def test_contrast_and_simple(spark, blocks):
    rows, _, _ = blocks
    _, importance = ML.contrast(rows.where("block = 'train'"), rows.where("block = 'validation'"), [0, 1, 2, 3, 4], depth=4)
    assert {"rtt", "region_0"} <= {r["column"] for r in importance.collect()}
    _, accuracy = ML.simple_tree(rows)
    assert {r.block for r in accuracy.collect()} == {"train", "validation", "test"}


def test_leaf_rules_select_their_rows(spark, blocks, tmp_path):
    """Every row lies in the leaf whose intervals it meets, and in no other."""
    rows, train, validation = blocks
    model = ML.fit_tree(train, depth=4)
    rules = U.leaf_rules(model, ML.feature_names(ML.ALL_COLUMNS), f"{tmp_path}/tree", train)
    assert len(rules) == len({r.leaf for r in model.transform(train).select("leaf").collect()}) >= 3
    scored = model.transform(validation).select("flow_id", "t", "leaf", vector_to_array("features").alias("features"))
    assert U.leaf_faults(scored, rules).count() == 0
    assert U.leaf_faults(scored.withColumn("leaf", F.col("leaf") + 1), rules).count() == scored.count()


@pytest.mark.parametrize("name", "m4_tree_scores m5_forest_scores m6_boost_scores m7_grid m9_families m10_contrast m11_leaf_profile m12_scored_classes m13_round_trip m15_simple_tree a21_importances q22_leaf_faults".split())
def test_models_compute_the_chain_once(spark, monkeypatch, name):
    read = spark.sparkContext.accumulator(0)
    plain = adapters.event_measurements

    def counted(spark, sf_dir):
        def told(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        rows = plain(spark, sf_dir)
        return rows.mapInArrow(told, rows.schema)

    monkeypatch.setattr(adapters, "event_measurements", counted)
    registry.QUERIES[name](spark, SF).collect()
    # The cards, their spread, and the rows that they are joined to.
    assert read.value <= 3 * adapters.table(spark, SF, "events").count()


def test_a_round_trip_counts_rows_of_one_key_once(spark, blocks, tmp_path):
    _, train, validation = blocks
    model = ML.fit_tree(train)
    other = ML.fit_tree(train.withColumn("label", 2 - F.col("label")))
    twice = validation.limit(50).unionByName(validation.limit(50)).cache()

    class Changed:
        """Comes back from its file as another model."""

        def write(self):
            return other.write()

        def transform(self, df):
            return model.transform(df)

    Changed.load = staticmethod(type(other).load)
    found = ML.round_trip(Changed(), twice, f"{tmp_path}/tree").count()
    assert 0 < found <= 100
