import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import packing
from tidewatch.llm.wordbytes import parts

PATH = packing.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, length=packing.LENGTH):
    """Every document whole and in one piece after another; sequences gapless, full or a power of two.  texts: (doc_id, text) of different ids."""
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes())
            if "ids" in r.__fields__:
                assert list(r.ids) == ids[d][r.start : at]
        assert at == len(ids[d])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at & (at - 1) == 0 or at == length)


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(packing.op11_packing(spark, "/root/testdata/sf0.01").collect(), docs, library)


def test_pieces_are_what_the_library_makes(library):
    rng = random.Random(3)
    letters = ["a", "B", "é", "é", "'", "'s", "'LL", " ", "\n", " ", "\x1c", "\x85", "1", "²", "<", "<|endoftext|>", "<|EndOfText|>", "-", ".", "Σ", "İ", "K", "x", "×", "÷", "É", "œ", "ÿ", "ǅ", "ɏ", "ɐ", "«", "中", "😀", "ﬁ", "the", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "a" * 100_000, "é" * 50_000, ".".join("ab" * 40 for _ in range(500)), "x" * 64 + " " + "x" * 65 + " " + "x" * 64 + "y"]
    encoder, got = packing.PieceEncoder(open(PATH, encoding="utf-8").read()), []
    for _, _, flat, at in parts(pa.array(texts), 20_000):
        ids, cut = encoder.encode(flat, at)
        got += [ids[i:j].tolist() for i, j in zip(cut.tolist(), cut[1:].tolist())]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_memory_of_pieces_starts_anew(library, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    encoder = packing.PieceEncoder(open(PATH, encoding="utf-8").read())
    for text in ["one two three four", "two four six", "one six"]:
        ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        packing.PieceEncoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_neighbours_on_the_curve_are_neighbours(dims):
    cells = np.array(list(itertools.product(range(8), repeat=dims)))
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(8**dims))
    assert (abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_edge_rows(spark, library):
    """Nulls, empty and very long texts, columns of clashing names; then equal rows by their number."""
    texts = [(1, None), (2, ""), (3, "a " * 300_000), (None, "b"), (5, "<|endoftext|>"), (6, "c" * 200_000)]
    docs = spark.createDataFrame([(*r, "k", 7) for r in texts], "doc_id long, text string, _key string, ids long")
    check(packing.packed(docs, PATH).collect(), texts, library)
    same = spark.range(3_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one two three' AS text")
    rows = packing.packed(same, PATH, length=64, with_ids=False).collect()
    assert sum(r.length for r in rows) == 3_000 * 4 and sum(r.start == 0 for r in rows) == 3_000
    assert len({r.sequence_id for r in rows}) >= 2
    assert packing.packed(docs.limit(0), PATH).collect() == []


def test_same_subjects_lie_together(spark):
    """Documents of two vocabularies: along the curve most neighbours are of one kind."""
    rng = random.Random(1)
    words = [["sea", "ship", "wave", "harbour", "sail", "tide", "wind", "anchor"], ["bread", "flour", "oven", "yeast", "dough", "salt", "crust", "butter"]]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2]) for _ in range(60))) for i in range(400)], "doc_id long, text string")
    rows = sorted(packing.packed(docs, PATH, length=4096, with_ids=False).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = [r.doc_id % 2 for r in rows if r.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:])) > 0.85 * len(order)
    again = packing.packed(docs.repartition(3), PATH, length=4096, with_ids=False).collect()
    assert sum(r.length for r in again) == sum(r.length for r in rows)
