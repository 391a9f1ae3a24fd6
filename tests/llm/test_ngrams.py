import random

import numpy as np

from pyspark.sql import functions as F

from corpus_pipeline import near_duplicate_stage
from tidewatch.llm import ngrams


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, s in enumerate(sets):
        for j in range(i):
            k = len(s & sets[j])
            if k and 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def corpus():
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(400)] + ["É", "\x1c", "a\xa0b"]
    passage = rnd.choices(words, k=60)
    rows = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([3, 5, 7, 30, 120]))
        for _ in range(rnd.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            rows.append(" ".join(own))
    rows += [" ".join(rnd.choices(words, k=20) + passage + rnd.choices(words, k=20)) for _ in range(50)]
    rows += [" ".join(passage[:-1] + [f"end{k}"]) for k in range(45)]  # a large group of near copies
    rows += [None, "", " \n\t", "one", "ONE", "two three", "x " * 5000]
    rows += rows[:6]
    rnd.shuffle(rows)
    return [(1000 - i if i % 17 else None, t) for i, t in enumerate(rows)] + [(1, rows[0]), (1, rows[0]), (2, rows[1])]


def order(r):
    return tuple((x is None, x or 0) for x in r)


def test_equals_all_pairs(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for settings in ({}, {"PIECE": 400, "TOGETHER": 500, "PAIRED": 4, "FREQUENT_COUNT": 5, "BATCH": 2000}, {"FREQUENT": 1, "POSTED": 500}, {"PAIRED": 1, "POSTED": 100}):
        for k, v in settings.items():
            monkeypatch.setattr(ngrams, k, v)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngrams.ngram_join(df).collect()]
        assert sorted(got, key=order) == sorted(plain(rows), key=order)
    assert ngrams.ngram_join(df.where("1 = 0")).collect() == []


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cls string")
    kept = [(r.doc_id, r.text) for r in ngrams.keep_one(df).collect()]
    sets = [plain_set(t) for _, t in kept]
    assert not any(len(a & b) * 180 >= 80 * (len(a) + len(b)) for i, a in enumerate(sets) for b in sets[:i] if a)
    parts = {c for (d, n, c), (_, t) in zip(plain(rows), rows) if plain_set(t) and c is not None}
    assert parts <= {d for d, _ in kept}
    nameless = spark.createDataFrame([(None, "a b c"), (None, "d e f"), (None, "a b c"), (None, ""), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in ngrams.keep_one(nameless).collect()) == ["", "None", "a b c", "d e f"]


def test_many_equal_rows_without_ids(spark):
    """100,000 equal rows without an id, a near copy, and columns of clashing names."""
    text = " ".join(f"w{k}" for k in range(60))
    hot = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"'{text}' AS text", "id AS key", "'x' AS row", "id AS _key")
    rest = spark.createDataFrame([(7, text + " more", 1, "y", 2), (8, "something else", 3, "z", 4)], hot.schema)
    docs = hot.unionByName(rest)
    got = {(r.doc_id, r.component_id): r.n for r in ngrams.ngram_join(docs).groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 7): 100_000, (7, 7): 1, (8, 8): 1}
    kept = ngrams.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [7, 8]


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 60, 25) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(25) < 0.12, rng.integers(0, 60, 25), b)).astype(np.uint64) for b in base for _ in range(8)]
    s, p = ngrams.tree_links(sets, sets)
    got = set(zip(s.tolist(), p.tolist()))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))}
    assert got == want


def unlike(n):
    """Texts that share phrases with many others and are like none, but for every tenth, which has a near copy."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(100_000)]
    phrases = [rnd.choices(words, k=6) for _ in range(2 * n // 5)]
    rows = []
    for i in range(n):
        own = rnd.choices(words, k=20) + [w for p in rnd.sample(phrases, 8) for w in p + rnd.choices(words, k=3)]
        rows += [(2 * i, " ".join(own))] + [(2 * i + 1, " ".join(own[:-1] + ["end"]))] * (i % 10 == 0)
    return rows


def watch_blocks(monkeypatch):
    """How many sets the largest block has, each time that blocks get their pieces."""
    for k, v in {"PAIRED": 4, "PIECE": 1_000, "TOGETHER": 1_000, "FREQUENT_COUNT": 10**9}.items():
        monkeypatch.setattr(ngrams, k, v)
    most = []
    plain_join = ngrams.join_facts
    monkeypatch.setattr(ngrams, "join_facts", lambda rows, facts, keys: (keys == ["block"] and most.append(facts.agg(F.max("n")).first()[0]), plain_join(rows, facts, keys))[1])
    return most


def test_phrases_of_many_unlike_sets_make_no_large_block(spark, monkeypatch):
    """Phrases that the table misses link a few sets each, and so nearly all of them; the pieces of one block would copy each set many times."""
    rows, most = unlike(300), watch_blocks(monkeypatch)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngrams.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(plain(rows))
    assert most[0] > 300 and most[-1] <= 40


def test_the_stage_of_the_pipeline_makes_no_large_block(spark, monkeypatch):
    rows, most = unlike(200), watch_blocks(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_duplicate_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [2 * i for i in range(200)]
    assert most[0] > 200 and most[-1] <= most[0] // 4
