import math
from collections import Counter, defaultdict

from tidewatch.llm import quality


def plain(texts, trusted):
    """Interpolated modified Kneser-Ney by dictionaries."""
    n = quality.ORDER
    marked = lambda t: "\x02" * (n - 1) + (t or "") + "\x03"
    grams = lambda t: [marked(t)[i : i + n] for i in range(len(marked(t)) - n + 1)]
    counts = {n: Counter(g for t in trusted for g in grams(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    alphabet = len({g[-1] for t in texts for g in grams(t)}) + 1
    cut, total, freed = {}, defaultdict(float), defaultdict(float)
    for k, c in counts.items():
        have = Counter(c.values())
        y = have[1] / (have[1] + 2 * have[2]) if have[1] else 0.0
        cut[k] = [min(max(i - (i + 1) * y * have[i + 1] / have[i] if have[i] else i / 2, 0.05), i) for i in (1, 2, 3)]
        for g, v in c.items():
            total[g[:-1], k] += v
            freed[g[:-1], k] += cut[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / alphabet
        k = len(g)
        t = total.get((g[:-1], k))
        if not t:
            return p(g[1:])
        v = counts[k][g]
        return (v - cut[k][min(v, 3) - 1] if v else 0) / t + freed[g[:-1], k] / t * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) for t in texts]


def test_equals_plain_model(spark, monkeypatch):
    texts = ["the cat sat", "the mat", "a cat é 😀", "", None, "zzz qqq", "the cat sat", "the hat sat on the cat " * 30, "x"]
    rows = [(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)] + [(0, None, texts[0]), (None, "de", "unnamed")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    good = spark.createDataFrame([(0,), (1,), (7,), (7,), (None,), (99,)], "doc_id long")
    want = plain([t for _, _, t in rows], [t for i, _, t in rows if i in (0, 1, 7)])
    for size in (1_000_000, 20, 0):  # all n-grams broadcast, few, none
        monkeypatch.setattr(quality, "FREQUENT", size)
        got = [(r.doc_id, r.trusted, round(r.perplexity, 6)) for r in quality.perplexities(docs, good).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(got, key=key) == sorted(((i, i in (0, 1, 7), round(w, 6)) for (i, _, _), w in zip(rows, want)), key=key)


def test_more_letters_than_a_number_holds(spark):
    """A text of 67,952 different characters: its n-grams are numbered without overflow."""
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 70_000) if not 0xD800 <= c < 0xE000][:67_952]
    text = "".join(chars)
    marked = "\x02" * 3 + text + "\x03"
    got = quality.ngram_counts(spark.createDataFrame([(text,), (text[:9],)], "text string")).collect()
    want = Counter([marked[i : i + 4] for i in range(len(marked) - 3)] + ["\x02" * 3 + text[0], "\x02\x02" + text[:2], "\x02" + text[:3], *(text[i : i + 4] for i in range(6)), text[6:9] + "\x03"])
    assert {r.g: r.c for r in got} == dict(want)
    docs = spark.createDataFrame([(1, "a", text), (2, "a", text[5:50]), (3, "a", None)], "doc_id long, lang string, text string")
    rows = {r.doc_id: r.perplexity for r in quality.perplexities(docs, docs.select("doc_id").where("doc_id = 1")).collect()}
    want = plain([text, text[5:50], None], [text])
    assert all(abs(rows[i + 1] - w) < 1e-6 * w for i, w in enumerate(want))


def test_long_text_and_many_equal_rows(spark):
    docs = spark.range(20_000).selectExpr("IF(id % 2 = 0, NULL, id) AS doc_id", "'en' AS lang", "'the same words' AS text")
    long = spark.createDataFrame([(-1, "en", "long text " * 500_000)], docs.schema)
    out = quality.perplexities(docs.unionByName(long), spark.createDataFrame([(1,)], "doc_id long"))
    r = out.selectExpr("count(*) AS rows", "count_if(trusted) AS trusted", "count(DISTINCT round(perplexity, 9)) AS kinds", "min(perplexity) AS least").first()
    assert (r.rows, r.trusted, r.kinds) == (20_001, 1, 2) and r.least > 1


def test_without_trusted_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "en", "abc")], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [r.kept for r in quality.classify(docs, none).collect()] == [True]
    assert quality.classify(docs.where("1 = 0"), none).collect() == []


def test_held_out_texts(spark):
    out = quality.op8_quality(spark, "/root/testdata/sf0.1").where("NOT trusted").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    r = out.selectExpr("avg(IF(quality = 1, CAST(kept AS INT), NULL)) AS good", "avg(IF(quality = 0, CAST(kept AS INT), NULL)) AS bad").first()
    assert r.good > 0.95 and r.bad < 0.2
