import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidewatch.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie by walking all prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in turns.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(int)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        s = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * (len(n[-1][1]) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(n)) for n, m in members.items()]


def same(df, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    """Few different turns, gaps in the numbers, conversations without turns of their own left, ids of many families."""
    rng = random.Random(seed)
    rows = [(c, turn, rng.choice(["user", None]), rng.choice(["a", "", None, "é😀"])) for c in rng.sample(range(700), 150) for turn in rng.sample([None, *range(9)], rng.randint(1, 8))]
    same(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)), rows)


def test_long_and_equal_conversations(spark, monkeypatch):
    """A chain of 700 turns over several parts, one that leaves it on the way, and many equal ones."""
    monkeypatch.setattr(tries, "PART", 64)
    rows = [(0, t, "u", f"t{t}") for t in range(700)] + [(1, t, "u", f"t{t}" if t < 400 else f"s{t}") for t in range(500)]
    rows += [(c, t, "u", "hello") for c in range(1000, 1200) for t in range(3)]
    extra = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", depth long, p1 string")
    same(tries.prefix_trie(extra.repartition(5)), rows)


def test_equal_turns_and_null_ids(spark):
    """Rows that are equal count one by one; those without an id are left out."""
    rows = [(7, None, None, None)] * 3_000 + [(None, 1, "u", "a")] * 5
    out = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    same(out, rows)
    ties = [(9, 1, "u", "a"), (9, 1, "u", "b"), (9, 1, "v", "a"), (9, 0, "u", "c")]
    one, other = (sorted(tries.prefix_trie(spark.createDataFrame(r, SCHEMA)).collect()[1:]) for r in (ties, ties[::-1]))
    assert one == other


def test_very_long_text_and_empty_table(spark):
    rows = [(100, 1, "u", "x" * 3_000_000), (101, 1, "u", "y"), (102, None, "u", "x" * 3_000_000)]
    same(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)), rows)
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
