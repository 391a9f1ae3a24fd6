import hashlib
import os
import re
import sys

import corpus_pipeline
from tokenizers import Tokenizer

from tidewatch.llm import bpe, toxicity
from tidewatch.llm.common import stored

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_mixing import plain_targets  # noqa: E402
from test_pii import plain as plain_spans  # noqa: E402
from test_toxicity import plain_bins  # noqa: E402

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def spans(text):
    """How many base spans of each kind, by the contract's patterns."""
    return plain_spans(text)[0]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_near_duplicates", "pii", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "toxicity":
            # The trained weights, applied character by character.
            found = toxicity.train(docs, toxicity.learning_labels(spark.read.parquet(f"{SF}/labels.parquet")))
            kept, short = {r.doc_id for r in after}, [r for r in before if len(r.text or "") < 1_500]
            assert len(kept) == len(after) and kept < {r.doc_id for r in before} and len(short) > 400
            for r in short:
                score = found.intercept + sum(float(found.weights[b]) for b in plain_bins(r.text))
                assert (r.doc_id in kept) == (score < 0), r.doc_id
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean, toxic = ([i in kept for i, v in labels.items() if v == k] for k in (0, 1))
            assert sum(clean) >= 0.99 * len(clean) and sum(toxic) <= 0.4 * len(toxic)
        if name == "ngram_near_duplicates":
            sets = {r.doc_id: shingles(r.text) for r in before}
            root = {i: i for i in sets}

            def find(i):
                return i if root[i] == i else find(root[i])

            ids = sorted(sets)
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    a, b = sets[i], sets[j]
                    if a and len(a) * 5 >= len(b) * 4 and len(b) * 5 >= len(a) * 4 and 180 * len(a & b) >= 80 * (len(a) + len(b)):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
            assert sorted(r.doc_id for r in after) == [i for i in ids if find(i) == i]
        if name == "pii":
            was, now = {r.doc_id: r.text for r in before}, {r.doc_id: r.text for r in after}
            assert len(after) == len(before) and was.keys() == now.keys() and all(r.n_chars == len(r.text) for r in after)
            for i, text in was.items():
                assert not any(spans(now[i])[k] for k in ("email", "ip", "card", "phone"))
                # What stands between the names of kinds comes from the text, in its order.
                at = 0
                for piece in re.split(r"\[(?:EMAIL|IP|CARD|PHONE|IBAN|SSN|ACCOUNT|SECRET)\]", now[i]):
                    assert (at := text.find(piece, at) + len(piece)) >= len(piece)
                assert (now[i] != text) >= any(spans(text).values())
        if name == "mixing":
            size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
            source = {r.doc_id: r.source for r in before}
            size_of, took, times = {}, {}, {}
            for i, n in size.items():
                size_of[source[i]] = size_of.get(source[i], 0) + n
            for r in after:
                times[r.doc_id] = times.get(r.doc_id, 0) + 1
                took[r.source] = took.get(r.source, 0) + size[r.doc_id]
            want = plain_targets(size_of)
            assert max(times.values()) <= 2 and set(times) <= set(size)
            for s, target in want.items():
                longest = max(n for i, n in size.items() if source[i] == s)
                assert abs(took.get(s, 0) - target) <= longest + 1e-6
        if name == "bpe":
            lib = Tokenizer.from_file(bpe.default_vocabulary())
            want = sorted((r.doc_id, len(e.ids), hashlib.sha256(r.text.encode()).hexdigest()) for r in before for e in [lib.encode(r.text, add_special_tokens=False)])
            assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after) == want
        docs = out


def test_run_and_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
