import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import resampling
from tidewatch.llm.wordbytes import crc32, parts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of_words(text, lo, hi):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return w, [" ".join(w[i : i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, words=(1, 1), buckets=10_000, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs_of_words(t, *words)[1])
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        w, f = runs_of_words(text, *words)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least))
    order = sorted((i for i, r in enumerate(rows) if r[4]), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(order[: 10 * len(order) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(rows)]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("words,buckets", [((1, 1), 10_000), ((1, 3), 97), ((2, 2), 64)])
def test_given_tables(spark, words, buckets, monkeypatch):
    monkeypatch.setattr(resampling, "STEP", 701)
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(resampling.resample(docs, target, words, buckets).collect(), plain(rows, [r.text for r in target.collect()], words, buckets))


def test_edge_rows(spark):
    """Nulls, empty and very long texts, equal rows, null ids, columns of clashing names."""
    long = "Alpha beta GAMMA d'elta " * 60_000
    rows = [(1, None), (2, ""), (3, long), (None, "é 中文 x " * 30), (5, "中" * 500_000), (6, "a" * 100), *[(8, "hot " * 30)] * 500, *[(None, "hot " * 30)] * 200]
    docs = spark.createDataFrame([(*r, 1, "s", 9) for r in rows], "doc_id long, text string, weight long, _slice string, rank long")
    target = [("beta hot",), (None,), ("",)]
    got = resampling.resample(docs.repartition(7), spark.createDataFrame(target, "text string")).collect()
    same(got, plain(rows, [t for t, in target]))
    assert sum(r.rank is not None for r in got) == 10 * 702 // 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    same(resampling.resample(some, none).collect(), plain([(1, "a b")], []))


def test_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    gain = rng.integers(-20_000, 20_000, 300)
    planes, values = resampling.gain_planes(gain)
    doc, bucket = rng.integers(0, 700, 90_000), rng.zipf(1.3, 90_000) % 300
    want = np.bincount(doc, weights=gain[bucket], minlength=700)
    assert (resampling.weights(doc, bucket, 700, planes, values, 300) == want).all()


def test_crc_of_many_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab€") for _ in range(rng.choice([0, 1, 3, 47, 48, 49, 300]))) for _ in range(500)]
    raw = [w.encode() for w in words]
    starts = np.cumsum([0, *map(len, raw)])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    before = np.arange(len(raw), dtype=np.uint32) * 77
    assert crc32(flat, starts[:-1], np.diff(starts), before).tolist() == [zlib.crc32(w, int(b)) for w, b in zip(raw, before)]


def test_parts_keep_texts_whole():
    texts = pa.array(["ab", None, "cdefgh", "", "i" * 50, "k"])
    for array in (texts, texts[1:5]):
        got = []
        for _, _, flat, at in parts(array, 8):
            got += [flat[i:j].tobytes().decode() for i, j in zip(at.tolist(), at[1:].tolist())]
        assert got == [t or "" for t in array.to_pylist()]
