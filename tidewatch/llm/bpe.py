"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index.

A task takes the texts of its partition part by part, splits them into words,
and encodes those distinct words that it hasn't met before.  For these it builds
one index that maps each pair of neighbouring symbols to all its places, takes
the active ranks in ascending order from a heap, merges the pair of that rank at
all its places at once, and updates the lists of the pairs that this makes.  In
a run of one symbol every second place is merged, counted from the run's start,
so a run takes as many steps as its length has digits.  No row leaves its
partition, so nothing is shuffled and a hot source or group of copies has no
cost of its own.  The vocabulary, of bounded size, is read once by the driver
and broadcast: no executor opens its file.

Defined results: a null text counts as empty; an empty text has no ids; ids of
null decode to the empty text; other columns of the input stay as they are.
The strings of special tokens become their ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the pattern that byte-level BPE vocabularies split texts by.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The characters that are encoded together; more than one text only up to here.
PART_CHARS = 2_000_000
#: Words, and ids of words, that a task remembers; beyond them it starts anew.
KNOWN_WORDS, KNOWN_IDS = 200_000, 2_000_000

NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _laid_out(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Items on end, and where each begins (with the end)."""
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum([0, *map(len, items)])


def gathered(flat: np.ndarray, at: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked items of ``flat`` (item i lies from at[i] to at[i + 1]) on end, and where each ends."""
    n = (at[1:] - at[:-1])[picks]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at[picks] - ends + n, n) + np.arange(total)], ends


def read_vocabulary(path: str) -> dict:
    """What encoding and decoding need of a tokenizers JSON file, as plain arrays."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids: dict[str, int] = spec["model"]["vocab"]
    letters = byte_letters()
    of_letter = {c: b for b, c in enumerate(letters)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    bytes_of = {i: bytes(of_letter[c] for c in s) for s, i in ids.items()}
    bytes_of |= {i: s.encode() for s, i in special.items()}
    width = max(bytes_of) + 1
    pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
    a, b, ab = (np.array([ids[x] for x in xs], np.int64) for xs in ([p[0] for p in pairs], [p[1] for p in pairs], [p[0] + p[1] for p in pairs]))
    codes, ranks = np.unique(a * width + b, return_index=True)
    return {
        "first": np.array([ids[c] for c in letters], np.int32),
        "special": special,
        "width": width,
        "byte_table": _laid_out([bytes_of.get(i, b"") for i in range(width)]),
        "name_table": _laid_out([b"%d," % i for i in range(width)]),
        "merged": ab.astype(np.int32),
        "codes": np.append(codes, np.iinfo(np.int64).max),
        "ranks": np.append(ranks, NO_RANK).astype(np.int32),
    }


class PairIndexEncoder:
    """Encodes and decodes with a vocabulary; remembers the words that it has encoded."""

    def __init__(self, vocabulary: dict) -> None:
        self.first, self.merged, self.codes, self.ranks = (vocabulary[k] for k in ("first", "merged", "codes", "ranks"))
        self.width, self.special = vocabulary["width"], vocabulary["special"]
        self.byte_table, self.name_table = vocabulary["byte_table"], vocabulary["name_table"]
        self.words = regex.compile(WORD_PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Knows the special tokens only."""
        self.known = {w: k for k, w in enumerate(self.special)}
        self.known_ids, self.known_at = np.array(list(self.special.values()), np.int32), np.arange(len(self.special) + 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_RANK where the vocabulary has none."""
        code = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.codes, code)
        return np.where((self.codes[at] == code) & (b >= 0) & (a >= 0), self.ranks[at], NO_RANK)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and where each word's ids begin (with the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        symbols = self.first[flat]
        symbols[ends] = -1  # parts the words and is in no pair
        n = len(symbols)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n + 1, NO_RANK, np.int32)  # of the pair that begins at a place
        rank[: n - 1] = self.rank(symbols[:-1], symbols[1:])

        index: dict[int, list[np.ndarray]] = {}  # the places of each pair, by its rank
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            of = rank[at]
            at, of = at[of < NO_RANK], of[of < NO_RANK]
            if not len(at):
                return
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(at)]
            for r, i, j in zip(of[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[i:j])

        add(np.flatnonzero(rank[:n] < NO_RANK).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if len(at) > 1:
                # Places stand in the order of the text.  Where one pair overlaps the next, every second one counts from the first on.
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    number = np.arange(len(at))
                    at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            following = after[gone]
            symbols[at] = self.merged[r]
            symbols[gone] = -2
            rank[gone] = NO_RANK
            after[at] = following
            before[following[following < n]] = at[following < n]
            left = before[at]
            touched = np.concatenate((at, left[left >= 0]))
            rank[touched] = self.rank(symbols[touched], symbols[after[touched]])
            add(np.unique(touched))
        parts = np.cumsum(symbols >= 0)
        return symbols[symbols >= 0], np.concatenate(([0], parts[ends]))

    def split(self, text: str) -> list[str]:
        """The words of a text and, as items of their own, its special tokens."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.words.findall(text[at:])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's ids begin (with the end)."""
        split = [self.split(t) for t in texts]
        words = list(chain.from_iterable(split))
        if len(self.known) > KNOWN_WORDS or len(self.known_ids) > KNOWN_IDS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            ids, at = self.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            self.known_ids, self.known_at = np.concatenate((self.known_ids, ids)), np.concatenate((self.known_at, at[1:] + len(self.known_ids)))
        own = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        out, ends = gathered(self.known_ids, self.known_at, own)
        return out, np.append(0, ends)[np.cumsum([0, *map(len, split)])]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, at = self.encode_all(texts)
        return [ids[i:j].tolist() for i, j in zip(at.tolist(), at[1:].tolist())]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of the ids between the given places."""
        raw, ends = gathered(*self.byte_table, ids)
        cuts, raw = np.append(0, ends)[at].tolist(), raw.tobytes()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def listed(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids between the given places, in decimal, joined by commas."""
        raw, ends = gathered(*self.name_table, ids)
        cuts, raw = np.append(0, ends)[at].tolist(), raw.tobytes()
        return [raw[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:])]


def _shipped(path: str) -> Broadcast:
    """The vocabulary for all workers: of bounded size, and plain arrays, so that a worker needs no copy of this module."""
    return SparkSession.active().sparkContext.broadcast(read_vocabulary(path))


def _parts(texts: pd.Series, most: int = PART_CHARS) -> Iterator[list[str]]:
    """A batch's texts, null as empty, in parts of bounded length."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(text: Column, vocabulary: str) -> Column:
    """array<int>: the ids of a text."""

    shipped = _shipped(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = PairIndexEncoder(shipped.value)
        for texts in batches:
            yield pd.Series([x for part in _parts(texts) for x in enc.encode_batch(part)], dtype=object)

    return ids(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """string: the text of an array of ids; null as no ids."""

    shipped = _shipped(vocabulary)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = PairIndexEncoder(shipped.value)
        for rows in batches:
            yield pd.Series([enc.decode(x if x is not None else []) for x in rows], dtype=object)

    return text(ids)


def round_trip(text: Column, vocabulary: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encodes, decodes the ids again, and digests both.

    One Python step, so the ids of a corpus need not pass to the JVM and back.
    """

    shipped = _shipped(vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = PairIndexEncoder(shipped.value)
        for texts in batches:
            rows = []
            for part in _parts(texts):
                ids, at = enc.encode_all(part)
                for n, listed, decoded in zip(np.diff(at).tolist(), enc.listed(ids, at), enc.decode_all(ids, at)):
                    rows.append((n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return docs.select("doc_id", round_trip(F.col("text"), vocabulary).alias("r")).select("doc_id", "r.*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), default_vocabulary())
