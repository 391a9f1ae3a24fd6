"""Tree models of Spark ML on the labelled rows: missing values, weights, grids on a time split, profiles, scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import CLASSES, EXTRA_COLUMNS, MODEL_COLUMNS
from .boosting import SoftmaxBoost, fit_softmax
from .checks import one_hot, weights
from .evaluate import class_metrics, confusion, summary_metrics, transitions

#: Stands for a missing value on either side of every split.
FAR = 1e30
#: Weights of the classes in training.
CLASS_WEIGHTS = {"OK": 1.0, "RISK": 2.0, "FAIL": 2.0}


def assemble(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Adds features.  Each column comes twice, missing values far below and far above, so that a split may send them either way."""
    sides = [F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(f"_{c}_{n}") for c in cols for n, v in (("low", -FAR), ("high", FAR))]
    names = [f"_{c}_{n}" for c in cols for n in ("low", "high")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *sides)).drop(*names)


def feature_names(cols: tuple[str, ...]) -> list[str]:
    return [c for c in cols for _ in range(2)]


def prepare(df: DataFrame, cols: tuple[str, ...], label: str = "status_future", class_weights: dict[str, float] = CLASS_WEIGHTS) -> DataFrame:
    """Rows to learn from: features, numeric label in the order of the classes, weight."""
    number = F.array_position(F.array(*map(F.lit, CLASSES)), F.col(label)) - 1
    return weights(assemble(df, cols).withColumn("label", number.cast("double")), label, class_weights)


def fit_tree(train: DataFrame, depth: int = 6, min_rows: int = 20, seed: int = 7) -> Model:
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_rows, seed=seed, weightCol="weight", leafCol="leaf").fit(train)


def fit_forest(train: DataFrame, trees: int = 50, depth: int = 8, min_rows: int = 20, seed: int = 7) -> Model:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, featureSubsetStrategy="sqrt", seed=seed, weightCol="weight").fit(train)


def fit_boost(train: DataFrame, rounds: int = 20, depth: int = 4, rate: float = 0.3, cols: tuple[str, ...] | None = None) -> SoftmaxBoost:
    """One softmax ensemble of boosted trees for all classes, on the columns that the rows were prepared with."""
    cols = cols or tuple(c for c in (*MODEL_COLUMNS, *EXTRA_COLUMNS) if c in train.columns)
    return fit_softmax(train, cols, len(CLASSES), rounds, depth, rate)


def fit_one_vs_rest(train: DataFrame, rounds: int = 20, depth: int = 4, seed: int = 7) -> Model:
    """The boosted trees of Spark ML, which part two classes, as one against the rest."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), weightCol="weight").fit(train)


def score(model: Model, df: DataFrame, model_id: str, keep: tuple[str, ...] = ("flow_id", "t")) -> DataFrame:
    """Class, probabilities where the model gives them, and the model's id."""
    out = model.transform(df)
    names = F.array(*map(F.lit, CLASSES))
    cols = [F.get(names, F.col("prediction").cast("int")).alias("model_pred"), F.lit(model_id).alias("model_id")]
    if "probability" in out.columns:
        p = F.col("probability") if dict(out.dtypes)["probability"] == "array<double>" else vector_to_array("probability")
        cols += [F.coalesce(F.get(p, i), F.lit(0.0)).alias(f"p_{c.lower()}") for i, c in enumerate(CLASSES)]
    return out.select(*keep, *(c for c in ("status_now", "status_future", "leaf") if c in out.columns and c not in keep), *cols)


def _macro_f1(counts: dict[tuple[str, str], int]) -> float:
    """Of a matrix (truth, prediction) -> rows; a class that nobody says and nobody is counts as 0."""
    each = []
    for c in CLASSES:
        hit = counts.get((c, c), 0)
        around = sum(n * ((truth == c) + (pred == c)) for (truth, pred), n in counts.items())
        each.append(2 * hit / around if around else 0.0)
    return sum(each) / len(CLASSES)


def grid(fit: Callable[..., Model], params: dict[str, list], train: DataFrame, validation: DataFrame, parallelism: int = 4) -> DataFrame:
    """(parameters..., f1_train, f1_validation, gap): fitted on the training block only, never on shuffled folds.

    Some fits run at a time; one job scores both blocks, and only the nine counts of each reach the driver.
    """
    both = train.withColumn("_part", F.lit("train")).unionByName(validation.withColumn("_part", F.lit("validation")))

    def row(values: tuple) -> tuple:
        model = fit(train, **dict(zip(params, values)))
        scored = score(model, both, "grid", ("_part",)).where("status_future IS NOT NULL")
        counts: dict[str, dict[tuple[str, str], int]] = {"train": {}, "validation": {}}
        for r in scored.groupBy("_part", "status_future", "model_pred").agg(F.count("*").alias("n")).collect():
            counts[r["_part"]][r.status_future, r.model_pred] = r.n
        f1 = [_macro_f1(counts[part]) for part in ("train", "validation")]
        return *values, *f1, f1[0] - f1[1]

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(train.sparkSession)(row), product(*params.values())))
    return train.sparkSession.createDataFrame(rows, [*params, "f1_train", "f1_validation", "gap"])


def compare_models(scored: dict[str, DataFrame]) -> DataFrame:
    """One row for each model, on the rows it scored: macro F1, accuracy, FAIL metrics, accuracy where the class changes."""
    out = None
    for name, df in scored.items():
        cm = confusion(df, "status_future", "model_pred")
        fail = class_metrics(cm).where("class = 'FAIL'").select(F.col("f1").alias("f1_fail"), F.col("recall").alias("recall_fail"))
        moved = transitions(df, "model_pred").where("now <> future").agg(F.try_divide(F.sum("hits"), F.sum("n")).alias("accuracy_changed"))
        row = summary_metrics(cm).crossJoin(F.broadcast(fail)).crossJoin(F.broadcast(moved)).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def importances(model: Model, cols: tuple[str, ...], name: str, df: DataFrame) -> DataFrame:
    """(model, column, importance): both sides of a column together."""
    found = model.featureImportances
    rows = list(found.items()) if isinstance(found, dict) else [(c, float(v)) for c, v in zip(feature_names(cols), found.toArray())]
    return df.sparkSession.createDataFrame(rows, "column string, importance double").groupBy("column").agg(F.sum("importance").alias("importance")).select(F.lit(name).alias("model"), "*")


def leaf_profile(scored: DataFrame) -> DataFrame:
    """(leaf, n, class, purity) and whether it is the fullest leaf of its class."""
    counts = scored.groupBy("leaf", "status_future").agg(F.count("*").alias("k"))
    leaves = counts.groupBy("leaf").agg(F.sum("k").alias("n"), F.max_by("status_future", F.struct("k", "status_future")).alias("class"), F.max("k").alias("_top"))
    fullest = leaves.groupBy("class").agg(F.max(F.struct("n", "leaf"))["leaf"].alias("_fullest"))
    return leaves.join(F.broadcast(fullest), "class").select("leaf", "n", "class", (F.col("_top") / F.col("n")).alias("purity"), (F.col("leaf") == F.col("_fullest")).alias("fullest"))


def round_trip(model: Model, df: DataFrame, path: str) -> DataFrame:
    """Rows whose prediction changes when the model is saved and loaded again: none."""
    if isinstance(model, SoftmaxBoost):
        model.save(df.sparkSession, path)
        again = SoftmaxBoost.load(df.sparkSession, path)
    else:
        model.write().overwrite().save(path)
        again = type(model).load(path)
    first = model.transform(df).select("*", F.col("prediction").alias("before")).select(*df.columns, "before")
    return again.transform(first).select("flow_id", "t", "before", F.col("prediction").alias("after")).where("before <> after")


def contrast(train: DataFrame, validation: DataFrame, categories: list, **params) -> tuple[Model, DataFrame]:
    """The tree with the absolute rtt and the region added, and the importance of its columns."""
    cols = (*MODEL_COLUMNS, "rtt", *(f"region_{v}" for v in categories))
    model = fit_tree(prepare(one_hot(train, "region", categories), cols), **params)
    return model, importances(model, cols, "contrast", train)


def simple_tree(df: DataFrame, cols: tuple[str, ...] = MODEL_COLUMNS) -> tuple[Model, DataFrame]:
    """A shallow tree on the current class, missing values as 0, and its accuracy in each block."""
    rows = prepare(df.na.fill(0, list(cols)), cols, "status_now")
    model = fit_tree(rows.where("block = 'train'"), depth=4, min_rows=1)
    scored = score(model, rows, "simple", ("flow_id", "t", "block"))
    return model, scored.groupBy("block").agg(F.avg((F.col("status_now") == F.col("model_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


#: The columns of the adjusted models.
ALL_COLUMNS = (*MODEL_COLUMNS, *EXTRA_COLUMNS)
