import math

import numpy as np

from pyspark.sql import functions as F

from tidewatch.llm import topk


def plain(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_all_scores(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.standard_normal(12) * (0.01 if i % 3 else 1)).tolist()) for i in rng.permutation(900)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(1000, rows[5][1]), (2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2050, [float("inf")] * 12), (None, [1.0] * 12), (3000, [1.0, 2.0]), (3050, [2.0, -1.0]), (4000, []), (5000, [0.0] * 12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for sizes in ((512, 4096), (7, 100)):
        monkeypatch.setattr(topk, "QUERIES", sizes[0])
        monkeypatch.setattr(topk, "CANDIDATES", sizes[1])
        assert sorted(map(tuple, topk.op2_topk(spark, str(tmp_path)).collect())) == plain(rows)


def test_scores_are_exact_beyond_doubles(spark):
    """Components around a million in double precision: products above 2**53, and differences that doubles don't hold."""
    rng = np.random.default_rng(3)
    rows = [(i, (1e6 + rng.integers(0, 2, 64) / 256 + 0.5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0).collect())) == plain(rows)
    most, least = 2**63 - 1, -(2**63)
    huge = spark.createDataFrame([(0, [1e30, 1e30]), (1, [1e30, 0.0]), (2, [-1e30, -1e30]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(topk.integer_vectors(huge), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, most), (3, most), (2, least)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.integer_vectors(df), F.lit(True)).collect() == []
