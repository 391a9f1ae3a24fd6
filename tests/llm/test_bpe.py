import hashlib
import random
import time

from tokenizers import Tokenizer

from tidewatch.llm import bpe


def texts():
    rnd = random.Random(1)
    bits = list("abthe 0'.\n\té漢😀́‍\xa0\x1c") + ["<|endoftext|>", "the ", "  ", "'ll"]
    return [None, "", "<|endoftext|>", "a" * 5000, " " * 300, "　x\x85", *("".join(rnd.choices(bits, k=rnd.randint(0, 60))) for _ in range(3000))]


def test_equals_the_library(spark, tmp_path):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    rows = [*enumerate(texts()), (None, "the same"), (None, "the same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op1_bpe(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_columns_round_trip(spark):
    from pyspark.sql import functions as F

    v = bpe.default_vocabulary()
    df = spark.createDataFrame([(t,) for t in texts()[:200]], "text string").select("*", bpe.encode(F.col("text"), v).alias("ids")).select("*", bpe.decode(F.col("ids"), v).alias("back"))
    assert all(r.back == (r.text or "") for r in df.collect())
    assert df.where("1 = 0").collect() == []


def test_runs_take_time_in_proportion_to_their_length():
    vocabulary, lib = bpe.read_vocabulary(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    for bit in ("a", "ab", "7", " ", "é", "aab"):
        took = []
        for n in (50_000, 200_000):
            began = time.time()
            ids = bpe.PairIndexEncoder(vocabulary).encode_batch([bit * n])[0]
            took.append(time.time() - began)
        assert took[1] < 5, (bit, took)
        assert bpe.PairIndexEncoder(vocabulary).decode(ids) == bit * n
        short = bit * 7_001
        assert bpe.PairIndexEncoder(vocabulary).encode_batch([short])[0] == lib.encode(short, add_special_tokens=False).ids


def test_words_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    enc, lib = bpe.PairIndexEncoder(bpe.read_vocabulary(bpe.default_vocabulary())), Tokenizer.from_file(bpe.default_vocabulary())
    for t in texts()[6:300]:
        assert enc.encode_batch([t, t]) == [lib.encode(t, add_special_tokens=False).ids] * 2
