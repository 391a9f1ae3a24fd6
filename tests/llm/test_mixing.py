import re

import numpy as np

from tidewatch.llm import mixing


def plain_targets(size_of):
    """Water filling as the contract words it: shares by weight, stopped, the excess reshared until none is above."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size_of else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(size_of.values())
    target, free = {s: 0.0 for s in names}, set(names)
    while free and total - sum(target[s] for s in names if s not in free) > 0:
        rest = total - sum(target[s] for s in names if s not in free)
        share = rest / sum(weight[s] for s in free)
        for s in free:
            target[s] = share * weight[s]
        over = {s for s in free if target[s] > 2 * size_of[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size_of[s]
        free -= over
    return target


def test_sizes_targets_and_balance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, None, None), (5, "", "zz"), (None, "a b\x0bc\x1cd\xa0e", None), (7, "one", "Z"), (7, "one", "Z")], "doc_id long, text string, source string")
    rows = docs.unionByName(odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size_of = {}
    for r in rows:
        size_of[r.source] = size_of.get(r.source, 0) + size(r.text)
    want = plain_targets(size_of)
    out = mixing.mix(docs.unionByName(odd)).collect()
    assert sorted(r["size"] for r in out) == sorted(size(r.text) for r in rows)
    units = {(r.source, r.doc_id): r for r in rows}
    source = {r.doc_id: r.source for r in rows if r.doc_id is not None}
    taken = {}
    for r in out:
        s = source.get(r.doc_id) if r.doc_id is not None else None
        if r.doc_id == 5 or r.doc_id == 7:
            continue
        assert r.source_size == size_of[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert units
    for s, words in taken.items():
        if s and s.startswith("src") and s not in ("src5", "src7"):
            longest = max(size(r.text) for r in rows if r.source == s)
            assert abs(words - want[s]) <= longest
    again = mixing.mix(docs.unionByName(odd).repartition(3)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(out, key=key) == sorted(again, key=key)


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 200).astype(float)
    start = np.full(200, 0.37)
    mean = np.zeros(200)
    for k in range(300):
        out = mixing.flight(size, start, np.random.default_rng(k))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - start.sum()) < 1e-6 and abs((out * size).sum() - (start * size).sum()) < 1e-3
        mean += out / 300
    assert abs(mean - 0.37).max() < 0.15


def test_many_equal_rows(spark, monkeypatch):
    """100,000 equal rows, null ids and columns of clashing names: equal rows lie in many groups."""
    monkeypatch.setattr(mixing, "EQUAL", 700)
    hot = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c' AS text", "'hot' AS source", "id AS _copy", "id AS row_hash", "'n' AS nth")
    rest = spark.range(50).selectExpr("id AS doc_id", "concat('w ', id) AS text", "'src' AS source", "id AS _copy", "id AS row_hash", "'n' AS nth")
    docs = hot.unionByName(rest)
    nth = mixing.numbered(mixing.sizes(hot)).selectExpr("count(*) AS n", "count(DISTINCT nth) AS numbers", "max(nth) AS last").first()
    assert (nth.n, nth.numbers, nth.last) == (100_000, 100_000, 99_999)
    r = mixing.mix(docs).where("doc_id IS NULL").selectExpr("count(*) AS rows", "sum(taken) AS words", "any_value(target) AS target", "max(copies) AS most").first()
    assert r.rows == 100_000 and abs(r.words - r.target) <= 3 and r.most <= 2
    out = mixing.repeat_taken(docs)
    assert out.columns == docs.columns and out.where("doc_id IS NULL").count() == r.words // 3


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000, "a"), (2, "x", "a"), (3, "y z", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r["size"] for r in mixing.mix(docs).collect()} == {1: 1_000_000, 2: 1, 3: 2}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == [] and mixing.repeat_taken(none).collect() == []
