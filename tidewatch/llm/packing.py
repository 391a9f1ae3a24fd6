"""Operator 11: packing documents into sequences along a space-filling curve.

Each text is encoded where it is read.  Its token counts, hashed to DIMS_HASHED
dimensions, are projected by random signs to a few coordinates, as sums of whole
numbers.  Over all documents the mean and spread of the coordinates are added
up; with them a document's coordinates become cells of a grid, and the cell's
place on a Hilbert curve is its key.  Documents are range-sorted by that key, so
neighbours in a sequence are about the same things, and each task packs its part
of the curve: documents follow each other, cut where a sequence is full.  The
last open sequence of a task is cut into sequences whose lengths are powers of
two, which need no padding.  Documents of one cell stand by id and by a number
of their own, so copies of one text needn't share a task.

Tokens come from the tokenizers library.  Texts are cut only where its
pre-tokenizer always cuts, at white space and, where a stretch holds nothing but
plain Latin text, between letters, digits and signs; a task encodes each different piece once.

Defined results: a null text counts as empty; an empty text is its final id
alone; null ids and equal rows are packed one by one; other columns are not
read; an empty table has no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, gathered
from .common import stored, table
from .wordbytes import owners, parts, runs

LENGTH = 2048
#: Fixed value: the id that ends a document.
END_ID = 1
#: Dimensions of hashed token counts, of the projection, and binary digits of a coordinate's cell.
DIMS_HASHED, DIMS, DIGITS = 4096, 4, 12
SEED = 11
#: Bytes of text that are encoded together, and pieces and ids that a task remembers; beyond them it starts anew.
PART, KNOWN, KNOWN_IDS = 2_000_000, 300_000, 3_000_000

#: How the vocabularies that this module encodes with normalize and split texts.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: Pieces up to this many bytes are compared with each other; longer ones stand alone.
SHORT = 64


def _kinds() -> np.ndarray:
    """What each byte is; odd are those whose stretch is left to the library whole."""
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = SIGN
    kind[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[[ord("'"), ord("<")]] = ODD  # of contractions and special tokens
    kind[0xC3:0xCA] = kind[0x80:0xC0] = LETTER  # the letters from U+00C0 to U+024F; what other leading bytes begin is odd
    return kind


KINDS = _kinds()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Characters of that range that are no letters, or whose lower case isn't one letter.
NO_LETTERS = [s.encode() for s in "\u00d7\u00f7\u0130"]
#: Keeps the first n bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def pieces(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, plain): pieces that the library encodes alike on their own; A-Z of plain ones are lower case."""
    kind = KINDS[flat]
    for lead, then in NO_LETTERS:
        at_lead = np.flatnonzero(flat == lead)
        kind[at_lead[flat[at_lead + 1] == then]] = ODD
    begin, end = runs(kind != SPACE, at)
    if not len(begin):
        return flat, begin, end, np.zeros(0, bool)
    odd = np.maximum.reduceat(kind, begin) == ODD
    change = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & (kind != SPACE)
    change[begin] = True
    starts = np.flatnonzero(change)
    stretch = np.cumsum(np.bincount(np.searchsorted(starts, begin), minlength=len(starts))) - 1
    keep = ~odd[stretch] | (starts == begin[stretch])
    starts, stretch = starts[keep], stretch[keep]
    ends = np.minimum(np.append(starts[1:], len(flat)), end[stretch])
    lower = LOWER[flat]
    for i, j in zip(begin[odd].tolist(), end[odd].tolist()):
        lower[i:j] = flat[i:j]
    return lower, starts, ends - starts, ~odd[stretch]


def alike(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): the first of each group of equal pieces, and each piece's group.  Hashes only propose, bytes decide."""
    eights = np.ndarray(len(flat) + 1, "<u8", np.append(flat, np.zeros(8, np.uint8)), strides=(1,))
    steps = range(0, min(SHORT, int(lengths.max(initial=0))), 8)

    def part(of: np.ndarray, step: int) -> np.ndarray:
        """Eight bytes of each piece from a step on, those beyond its end as zero."""
        return eights[starts[of] + step] & FIRST_BYTES[np.minimum(lengths[of] - step, 8)]

    longer = {step: np.flatnonzero((lengths > step) & (lengths <= SHORT)) for step in steps}
    hashes = np.zeros(len(starts), np.uint64)
    for step, some in longer.items():
        hashes[some] = hashes[some] * np.uint64(0x9E3779B97F4A7C15) + part(some, step)
    code, _ = pd.factorize(hashes)
    first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    same = (lengths == lengths[first[code]]) & (lengths <= SHORT)
    for step, some in longer.items():
        some = some[same[some]]
        same[some] = part(some, step) == part(first[code[some]], step)
    same[first] = True
    apart = np.flatnonzero(~same)
    code[apart] = len(first) + np.arange(len(apart))
    return np.append(first, apart), code


class PieceEncoder:
    """Encodes texts with a tokenizers vocabulary; remembers the pieces that it has encoded."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        splits = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if spec["normalizer"]["normalizers"] != NORMALIZERS or splits != [PATTERN] or any("<" != t["content"][:1] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("the vocabulary splits texts in another way than this module knows")
        spec["truncation"] = spec["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, plain: list[bytes], odd: list[bytes]) -> None:
        """Adds pieces that aren't known."""
        tokens, letters = self.model.tokenize, self.letters
        spelled = [p.decode() if p.isascii() else p.decode().lower().encode().decode("latin-1").translate(letters) for p in plain]
        found = [[t.id for t in tokens(p)] for p in spelled]
        found += [e.ids for e in self.library.encode_batch([p.decode() for p in odd], add_special_tokens=False)]
        n = len(self.known)
        self.known.update(zip((*plain, *odd), range(n, n + len(found))))
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(f) for f in found]))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), np.int64))

    def encode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts on end, and where each text's ids begin (with the end)."""
        low, starts, lengths, plain = pieces(flat, at)
        first, code = alike(low, starts, lengths)
        if len(self.known) > KNOWN or len(self.ids) > KNOWN_IDS:
            self.forget()
        raw = low.tobytes()
        names = [raw[i : i + n] for i, n in zip(starts[first].tolist(), lengths[first].tolist())]
        new = {p: q for p, q in zip(names, plain[first].tolist()) if p not in self.known}
        if new:
            self.learn([p for p, q in new.items() if q], [p for p, q in new.items() if not q])
        own = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[code]
        ids, ends = gathered(self.ids, self.at, own)
        upto = np.searchsorted(starts, at)  # pieces before each text
        return ids, np.append(0, ends)[upto]


def signs(n_ids: int) -> np.ndarray:
    """For each id the random signs, one a coordinate, of the hashed dimension that it falls into."""
    rng = np.random.default_rng(SEED)
    dimension = rng.integers(0, DIMS_HASHED, n_ids)
    return rng.choice(np.array([-1, 1], np.int64), (DIMS_HASHED, DIMS))[dimension]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, n, x): ids as little-endian numbers of two or four bytes, the final one included, their number, and the projected sums."""
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    n_ids = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), END_ID]) + 1
    shipped = docs.sparkSession.sparkContext.broadcast(text)  # a vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sign, width = None, signs(n_ids), _width(n_ids)
        for batch in batches:
            encoder = encoder or PieceEncoder(shipped.value)
            for i, j, flat, at in parts(batch.column(1), PART):
                ids, cut = encoder.encode(flat, at)
                ids = np.insert(ids, cut[1:], END_ID)
                cut = cut + np.arange(len(cut))
                x = np.add.reduceat(sign[ids], cut[:-1], axis=0)
                raw = ids.astype(width).tobytes()
                size = np.dtype(width).itemsize
                rows = [raw[a * size : b * size] for a, b in zip(cut.tolist(), cut[1:].tolist())]
                listed = pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIMS, dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows, pa.binary()), pa.array(np.diff(cut)), listed], ["doc_id", "ids", "n", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary, n long, x array<long>")


def _width(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def hilbert(cells: np.ndarray, digits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells, by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(digits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            on = x[d] >> bit & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(digits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(digits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> bit & 1)
    return key


def curve_key(rows: DataFrame) -> Column:
    """long: the Hilbert key of (n, x), by the mean and spread of all rows' coordinates."""
    whole = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0)).cast("double")
    n, x = F.col("n"), [F.col("x")[d] for d in range(DIMS)]
    # Sums of whole numbers don't depend on the order of the rows, so reruns agree.
    found = rows.agg(F.count("*"), whole(n), *map(whole, x), *(whole(F.floor(c * c * 16 / n)) for c in x)).first()
    n_docs, total = max(1, found[0]), max(1.0, found[1])
    mean = np.array(found[2 : 2 + DIMS]) / total
    spread = np.sqrt(np.maximum(np.array(found[2 + DIMS :]) / 16 / n_docs - mean**2 * total / n_docs, 1e-9))

    @F.pandas_udf("long")
    def key(n: pd.Series, x: pd.Series) -> pd.Series:
        sums, n = np.array(x.tolist(), np.float64).reshape(-1, DIMS), n.to_numpy(np.float64)[:, None]
        z = (sums - n * mean) / np.sqrt(n) / spread
        cells = np.floor((1 << DIGITS) / (1 + np.exp(-1.702 * np.clip(z, -20, 20))))  # about the same share of a bell curve in each cell
        return pd.Series(hilbert(np.clip(cells, 0, (1 << DIGITS) - 1), DIGITS))

    return key(n, F.col("x"))


def cut_into(held: list[tuple], sizes: list[int]) -> Iterator[list[tuple]]:
    """Pieces (doc_id, start, ids, n) on end, cut into sequences of the given sizes, which add up to them."""
    queue = held[::-1]
    for size in sizes:
        out, left = [], size
        while left:
            doc_id, start, ids, n = queue.pop()
            if len(ids) > left:
                queue.append((doc_id, start + left, ids[left:], n))
                ids = ids[:left]
            out.append((doc_id, start, ids, n))
            left -= len(ids)
        yield out


def sequences(docs: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """Documents (doc_id, ids) in their order as sequences: full ones, then one for each binary digit of the rest."""
    held, fill = [], 0
    for doc_id, ids in docs:
        n, start = len(ids), 0
        while start < n:
            more = ids[start : start + length - fill]
            held.append((doc_id, start, more, n))
            start, fill = start + len(more), fill + len(more)
            if fill == length:
                yield held
                held, fill = [], 0
    yield from cut_into(held, [1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1])


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids as array<int>): a row for each piece.

    docs needs doc_id and text.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    width = _width(max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), END_ID]) + 1)
    made = stored(encoded(docs, vocabulary))
    order = ["_key", F.col("doc_id").asc_nulls_last(), "_own"]
    along = made.withColumn("_key", curve_key(made)).withColumn("_own", F.monotonically_increasing_id()).drop("x")
    along = along.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = made.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId() << 40, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [arrow, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        docs = ((d, np.frombuffer(b, width)) for batch in batches for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for sequence in sequences(docs, length):
            offset = 0
            for doc_id, start, ids, n in sequence:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset, *[ids] * with_ids))
                offset += len(ids)
            number += 1
            if len(rows) > 5_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    types = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return along.mapInArrow(pack, types)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)
