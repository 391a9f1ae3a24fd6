import math
import random
import zlib

import numpy as np

from tidewatch.llm import toxicity


def test_held_out_accuracy_and_rows(spark):
    out = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").dropDuplicates(["doc_id"])
    both = out.join(labels, "doc_id").where("held_out")
    r = both.selectExpr("avg(IF(toxic = 1, predicted, NULL)) AS recall", "avg(IF(toxic = 0, predicted, NULL)) AS false_share").first()
    assert r.recall > 0.85 and r.false_share < 0.01
    rows = out.collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def plain_bins(text):
    """The bins of a text's n-grams, one character at a time."""
    codes, out = [ord(c) for c in f" {text or ''} ".lower()], set()
    for n in toxicity.ORDERS:
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(n):
                h = (h ^ codes[i + k] * int(toxicity._MIX[k]) % 2**32) * 0x01000193 % 2**32
            out.add((h ^ h >> 15) % toxicity.BINS)
    return out


def test_counts_ratios_and_scores_by_plain_python(spark):
    rnd = random.Random(3)
    words = ["you", "idiot", "fool", "day", "Fine", "é😀", "a", "the", "hate", "tree"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for i in range(120)]
    label = {i: int("idiot" in t or "hate" in t) for i, t in rows}
    docs = spark.createDataFrame([*rows, (500, "new idiot"), (501, "new day"), (502, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(label.items()), "doc_id long, label int"))
    bins = {i: plain_bins(t) for i, t in rows}
    assert all(set(toxicity.ngrams(t).tolist()) == bins[i] for i, t in rows)
    n = [sum(v == k for v in label.values()) for k in (0, 1)]
    count = lambda b, k: sum(b in bins[i] for i, v in label.items() if v == k)
    seen = set().union(*bins.values())
    learn = docs.join(spark.createDataFrame(list(label.items()), "doc_id long, label int"), "doc_id").select("text", "label")
    got = {r.bin: r.ratio for r in toxicity.log_count_ratios(toxicity.bin_counts(learn), n[1], n[0]).collect()}

    def g(b):
        """The G statistic of the four counts: toxic and clean, with and without the bin."""
        total, out = len(label), 0.0
        for k in (0, 1):
            for seen, of in ((count(b, k), count(b, 0) + count(b, 1)), (n[k] - count(b, k), total - count(b, 0) - count(b, 1))):
                out += 2 * seen * math.log(seen * total / (n[k] * of)) if seen else 0.0
        return out

    want = {b: math.log((count(b, 1) + 1) / (n[1] + 2)) - math.log((count(b, 0) + 1) / (n[0] + 2)) for b in seen if g(b) >= toxicity.EVIDENCE}
    assert got.keys() == want.keys() and want and all(abs(got[b] - want[b]) < 1e-9 for b in want)
    assert set(np.flatnonzero(model.weights)) <= want.keys()
    plain_score = lambda t: 1 / (1 + math.exp(-model.intercept - sum(float(model.weights[b]) for b in plain_bins(t))))
    assert all(abs(r.score - plain_score(r.text)) < 1e-9 for r in docs.select("text", model.score(docs.text).alias("score")).collect())
    # The weights are the optimum: the mean loss and the penalty balance in every bin.
    wrong = {i: plain_score(t) - label[i] for i, t in rows}
    assert abs(sum(wrong.values())) / len(rows) < 1e-3
    for b in want:
        if abs(want[b]) > 1e-9:
            slope = want[b] * sum(wrong[i] for i in bins if b in bins[i]) / len(rows) + toxicity.REGULARIZATION * float(model.weights[b]) / want[b]
            assert abs(slope) < 1e-3


def test_nulls_repeats_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "you idiot"), (None, None), (2, ""), (3, "fine day"), (4, "x" * 300_000)], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.score for r in docs.select(none.score(docs.text).alias("score")).collect()} == {0.0}
    some = toxicity.train(docs, spark.createDataFrame([(1, 1), (1, 0), (3, 0), (2, 0), (None, 1), (4, None)], "doc_id long, label int"))
    got = docs.select("text", some.score(docs.text).alias("score")).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(abs(r.score - 1 / 2) < 1e-9 for r in got)  # nothing tells so few labels apart beyond chance
    pairs = [(100 + i, "you idiot" if i % 2 else "fine day") for i in range(60)]
    more = toxicity.train(docs.unionByName(spark.createDataFrame(pairs, docs.schema)), spark.createDataFrame([(i, i % 2) for i, _ in pairs], "doc_id long, label int"))
    assert all((r.score > 0.5) == (r.text == "you idiot") for r in docs.select("text", more.score(docs.text).alias("score")).collect())
    assert docs.where("1 = 0").select(some.score(docs.text)).collect() == []
