"""Operator 5: n-gram Jaccard join of documents with prefix trees.

A document's set holds its distinct word 5-grams, as 64-bit hashes.  Sets that
are equal form one class, so exact copies never meet each other in pairs.

1. All sets are counted for a table of very frequent n-grams, of bounded size.
   The global order of n-grams is: those not in the table by hash, then those in
   it, rarest first.  Any table gives a valid order; a good one keeps passages
   that many documents share out of the prefixes.
2. Two sets with Jaccard similarity >= t share one of their first
   n - ceil(t n) + 1 n-grams in that order.  These prefixes are dealt by n-gram.
   N-grams with few classes give pairs, which must share enough of their prefixes
   for the lengths that remain; n-grams with many classes link each to the first,
   so no group ever yields all its pairs.  An n-gram that has many classes in one
   task's prefixes already links them there and sends the first one on only.  The components of these candidate
   links are blocks: every true pair lies within one block.
   Links that no pair was checked for can join unlike sets, more of them the larger the corpus.  So the sets of large
   blocks are dealt anew, with the n-grams that linked many classes last in the order, until blocks stay as they are.
3. A block's sets, in pieces of bounded size, are stored in a prefix tree (most
   frequent first, so copies share paths) and traversed once for all the sets
   that probe it, carrying the overlaps so far down the shared paths and leaving
   subtrees that no probe can still reach with the lengths that remain.
4. The links' spanning forests give the components.

Defined results: a null or empty text, or one without words, has the empty set
and links with nothing; a text of fewer than five words has its whole sequence
as one n-gram; equal rows are a class like any other; a null doc_id is never a
component's id unless all its ids are null; other columns are not read.  Sets
and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_facts, release, stored, table
from .components import connected_components, local_roots

#: Words of an n-gram, and the similarity as a fraction.
WORDS = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Most rows of the table of frequent n-grams, and the count that brings one in.
FREQUENT, FREQUENT_COUNT = 400_000, 6
#: Bytes of text that are hashed together.
TEXT = 1_000_000
#: N-grams of a batch counted together.
BATCH = 4_000_000
#: Most classes of an n-gram that are paired with each other.
PAIRED = 128
#: Prefix entries that a task looks through together for n-grams with many classes.
POSTED = 2_000_000
#: N-grams of the sets of one piece of a block, and of blocks joined in one call.
PIECE, TOGETHER = 300_000, 100_000
#: Blocks are refined while their pieces make of all sets more copies than this on average, and while that leaves at most so much of the copies.
COPIES, LEFT = 2, 0.8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[:1] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each run of bytes that aren't white space."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP), starts


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z in lower case."""
    part: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(part[-1])
        if size > TEXT or k == len(texts) - 1:
            yield from _sets_of(part)
            part, size = [], 0


def _sets_of(part: list[bytes]) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
    words, starts = _word_hashes(raw)
    firsts = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in part)]))
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = _mix(rolled)
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= WORDS:
            found = np.sort(rolled[a : b - WORDS + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = _mix(np.array([whole], np.uint64) * _STEP + w)[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.empty(0, np.uint64)


def set_hash(found: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = _mix(found ^ _STEP).sum(dtype=np.uint64) + np.uint64(len(found)) * _BASE
    return int(_mix(np.array([total], np.uint64)).view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


def _batches(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    yield from enumerate(shingle_sets(rows["text"].tolist()))


_FACTS = "doc_id long, text_hash long, cls long, n long, gram long, seen long"


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document, and rows (gram, seen) for n-grams that several different sets of a batch hold."""
    held: list[np.ndarray] = []
    known: set[int] = set()
    size = 0

    def counts() -> pd.DataFrame:
        grams = np.concatenate(held) if held else np.empty(0, np.uint64)
        held.clear()
        grams.sort()
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
        seen = np.diff(np.append(first, len(grams)))
        many = seen > 1
        return pd.DataFrame({"gram": grams[first[many]].view(np.int64), "seen": seen[many]}, dtype="Int64")

    for rows in batches:
        cls, n = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i, found in _batches(rows):
            cls[i], n[i] = set_hash(found), len(found)
            if cls[i] not in known:
                known.add(int(cls[i]))
                held.append(found)
                size += len(found)
            if size >= BATCH:
                yield counts()
                held, known, size = [], set(), 0
        yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "text_hash": rows["text_hash"], "cls": cls, "n": n})
    yield counts()


def _in_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.reindex(columns=[c.split()[0] for c in _FACTS.split(", ")]).astype("Int64")


#: A prefix entry: an n-gram, a class that holds it and the size of the class's set, 0 where the n-gram has many classes.
#: A link that a task has found already: a class, the class that it is linked to, and -1.
_POSTED = "key long, cls long, n long"


def _prefixes(frequent: np.ndarray):
    """frequent: the hashes in the table, rarest first."""
    by_hash = np.argsort(frequent)
    keys = frequent[by_hash]

    def ordered(found: np.ndarray) -> np.ndarray:
        if not len(keys):
            return found
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        common = keys[at] == found
        return np.concatenate((found[~common], found[common][np.argsort(by_hash[at[common]])]))

    def sent(grams: list[np.ndarray], cls: list[int], n: list[int]) -> pd.DataFrame:
        """Entries; where an n-gram has many classes here, only that of its least one, and links of the others to it."""
        sizes = [len(g) for g in grams]
        gram, of, size = np.concatenate(grams).view(np.int64), np.repeat(np.array(cls, np.int64), sizes), np.repeat(np.array(n, np.int64), sizes)
        order = np.lexsort((of, gram))
        by_gram, by_class = gram[order], of[order]
        first = np.flatnonzero(np.append(True, by_gram[1:] != by_gram[:-1]))
        times = np.diff(np.append(first, len(gram)))
        least, many = np.repeat(by_class[first], times), np.repeat(times > PAIRED, times)
        drop = many & (by_class != least)
        keep = np.ones(len(gram), bool)
        size[order[many]] = 0
        keep[order[drop]] = False
        # In the order of the classes, which packs better than that of the n-grams.
        posted = pd.DataFrame({"key": gram[keep], "cls": of[keep], "n": size[keep]})
        if not drop.any():
            return posted
        return pd.concat((posted, pd.DataFrame({"key": by_class[drop], "cls": least[drop], "n": -1}).drop_duplicates()))

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        grams: list[np.ndarray] = []
        cls: list[int] = []
        n: list[int] = []
        size = 0
        for rows in batches:
            for _, found in _batches(rows):
                own = set_hash(found)
                if len(found) and own not in known:
                    known.add(own)
                    grams.append(ordered(found)[: prefix_length(len(found))])
                    cls.append(own)
                    n.append(len(found))
                    size += len(grams[-1])
                if size >= POSTED:
                    yield sent(grams, cls, n)
                    grams, cls, n, size = [], [], [], 0
                    known.clear()
        if grams:
            yield sent(grams, cls, n)

    return postings


def _needed(a: Column, b: Column) -> Column:
    """The least overlap of two sets of these sizes that links them."""
    return F.ceil(NUMERATOR * (a + b) / (NUMERATOR + DENOMINATOR))


def candidate_links(docs: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between classes; every pair of similar sets is connected by them.  And (gram, linked, classes): the n-grams that linked many."""
    posted = docs.select("text").mapInPandas(_prefixes(frequent), _POSTED)
    by = Window.partitionBy("key")
    new = F.coalesce(F.lag("cls").over(by.orderBy("cls")) != F.col("cls"), F.lit(True))
    posted = posted.select("*", new.alias("new"), F.max(F.col("n") == 0).over(by).alias("linked")).where("new OR n < 0")
    posted = posted.select("key", "cls", "n", "linked", F.count("*").over(by).alias("classes"), F.min("cls").over(by).alias("least"))
    shared = stored(posted.where("classes > 1 OR n < 0"))
    found = shared.where("n < 0").select(F.col("key").alias("a"), F.col("cls").alias("b"))
    shared = shared.where("n >= 0").withColumnRenamed("key", "gram")
    pairwise = ~F.col("linked") & (F.col("classes") <= PAIRED)
    few = shared.where(pairwise)
    x = few.select("gram", F.col("cls").alias("a"), F.col("n").alias("na"))
    y = few.select("gram", F.col("cls").alias("b"), F.col("n").alias("nb"))
    near = (DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    pairs = x.join(y, "gram").where(near).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    beyond = F.ceil(NUMERATOR * F.greatest("na", "nb") / DENOMINATOR) - 1
    pairs = pairs.where(F.col("both") + beyond >= _needed(F.col("na"), F.col("nb"))).select("a", "b")
    many = shared.where(~pairwise & (F.col("cls") != F.col("least"))).select(F.col("least").alias("a"), F.col("cls").alias("b"))
    heavy = shared.where(~pairwise).groupBy("gram").agg(F.max("linked").alias("linked"), F.max("classes").alias("classes"))
    return pairs.unionByName(many).unionByName(found), heavy


def _last(heavy: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """frequent with the heavy n-grams at its end, those of the most classes last."""
    top = heavy.orderBy(F.desc("linked"), F.desc("classes"), "gram").limit(FREQUENT).toPandas()  # of bounded size
    found = top["gram"].to_numpy()[::-1].astype(np.int64).view(np.uint64)
    return np.concatenate((frequent[~np.isin(frequent, found)], found))


def _members(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """(cls, block, grams, one_id, one_hash): the classes that have links, the sizes of their sets and a document of each."""
    blocks = connected_components(links)
    members = blocks.select(F.col("node").alias("cls"), F.col("component").alias("block")).unionByName(blocks.select(F.col("component").alias("cls"), F.col("component").alias("block")).distinct())
    return stored(members.join(firsts, "cls").select("cls", "block", F.col("n").alias("grams"), F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")))


def _in_pieces(members: DataFrame) -> tuple[DataFrame, int, int]:
    """members with the number of pieces of their block, the n-grams of all, and those of all copies that the pieces need."""
    sizes = members.groupBy("block").agg(F.sum("grams").alias("grams"), F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("grams") / PIECE))
    once, copied = sizes.agg(F.sum("grams"), F.sum(F.col("grams") * F.col("pieces"))).first()
    return join_facts(members, sizes.drop("grams"), ["block"]).drop("n"), once or 0, copied or 0


def tree_links(sets: list[np.ndarray], probes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which probes are similar to which sets, by one traversal of a prefix tree of the sets.

    The tree is kept as the sets in lexicographic order: a node is a run of sets
    with a common beginning.
    """
    everything = np.concatenate([*sets, *probes])
    grams, number, times = np.unique(everything, return_inverse=True, return_counts=True)
    place = np.empty(len(grams), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(grams))
    number = np.split(place[number], np.cumsum([len(s) for s in (*sets, *probes)])[:-1])
    stored_sets = [np.sort(s).tolist() for s in number[: len(sets)]]
    order = sorted(range(len(sets)), key=stored_sets.__getitem__)
    tree = [stored_sets[i] for i in order]
    arrays = [np.array(t, np.int64) for t in tree]
    sizes = np.array([len(p) for p in probes])
    holders = np.repeat(np.arange(len(probes)), sizes)
    flat = np.concatenate(number[len(sets) :])
    by_gram = np.argsort(flat, kind="stable")
    holders, at = holders[by_gram], np.searchsorted(flat[by_gram], np.arange(len(grams) + 1))
    found_set, found_probe = [], []
    unit = NUMERATOR + DENOMINATOR
    stack = [(0, len(tree), 0, np.zeros(len(probes), np.int64))]
    while stack:
        low, high, depth, overlap = stack.pop()
        a, b = tree[low], tree[high - 1]
        end = min(len(a), len(b))
        if low + 1 < high:
            differ = np.flatnonzero(arrays[low][depth:end] != arrays[high - 1][depth:end])
            end = depth + int(differ[0]) if len(differ) else end
        if end > depth:
            segment = arrays[low][depth:end]
            n = at[segment + 1] - at[segment]
            ends = np.cumsum(n)
            picks = np.repeat(at[segment] - ends + n, n) + np.arange(ends[-1])
            overlap = overlap + np.bincount(holders[picks], minlength=len(probes))
        lengths = [len(tree[k]) for k in range(low, high)]
        can = overlap + np.minimum(max(lengths) - end, sizes - overlap)
        if not (unit * can >= NUMERATOR * (sizes + min(lengths))).any():
            continue
        while low < high and len(tree[low]) == end:
            hits = np.flatnonzero(unit * overlap >= NUMERATOR * (sizes + end))
            found_probe.append(hits)
            found_set.append(np.full(len(hits), order[low]))
            low += 1
        while low < high:
            k = low + 1
            while k < high and tree[k][end] == tree[low][end]:
                k += 1
            stack.append((low, k, end, overlap))
            low = k
    if not found_set:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_set), np.concatenate(found_probe)


def _join_pieces(group: pd.DataFrame) -> pd.DataFrame:
    """Spanning forests of the links in each (block, i, j) of a group."""
    out = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
    for (_, i, j), rows in group.groupby(["block", "i", "j"]):
        rows = rows.drop_duplicates("cls").sort_values("cls")
        cls = rows["cls"].to_numpy()
        grams = [np.asarray(g, np.int64).view(np.uint64) for g in rows["grams"]]
        left, right = np.flatnonzero(rows["piece"] == i), np.flatnonzero(rows["piece"] == j)
        if len(rows) < 2 or not len(left) or not len(right):
            continue
        s, p = tree_links([grams[k] for k in left], [grams[k] for k in right])
        roots = local_roots(len(rows), left[s], right[p])
        moved = np.flatnonzero(roots != np.arange(len(rows)))
        out.append(pd.DataFrame({"a": cls[moved], "b": cls[roots[moved]]}))
    return pd.concat(out)


def ngram_join(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component) for every row of docs (doc_id, text).

    component numbers the components; it is null for the empty set.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_columns(_facts(batches))

    found = stored(docs.mapInPandas(facts, _FACTS))
    rows = found.where("cls IS NOT NULL").select("doc_id", "text_hash", "cls", "n")
    counted = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT_COUNT)
    top = counted.orderBy(F.desc("seen"), "gram").limit(FREQUENT).toPandas()  # of bounded size
    frequent = top["gram"].to_numpy()[::-1].astype(np.int64).view(np.uint64)

    firsts = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"), F.count("*").alias("held"))
    links, heavy = candidate_links(docs, frequent)
    members = _members(links, firsts)
    placed, once, copied = _in_pieces(members)
    # Repeats of a row go before the shuffle, which serves the join too.  The members grow with the corpus, so they are never broadcast.
    one = docs.select(F.xxhash64("doc_id", "text_hash").alias("key"), "text_hash", "text").dropDuplicates(["key"])
    # The hashes are compared in a form that is no key of the join, so that the texts are not shuffled a second time for it.
    texts = one.join(placed.withColumn("key", F.xxhash64("one_id", "one_hash")).hint("merge"), "key").where(F.col("text_hash").bitwiseXOR(F.col("one_hash")) == 0).select("text", "cls", "block", "pieces")
    if copied > COPIES * once:
        kept, before = stored(texts.select("text", "cls")), np.inf
        while copied > COPIES * once and copied <= LEFT * before:
            frequent = _last(heavy, frequent)
            large = stored(kept.join(placed.where("pieces > 1").select("cls").hint("merge"), "cls", "left_semi"))
            links, heavy = candidate_links(large, frequent)
            release(large)
            members = stored(placed.where("pieces = 1").drop("pieces").unionByName(_members(links, firsts)))
            before = copied
            placed, once, copied = _in_pieces(members)
        texts = kept.join(placed.select("cls", "block", "pieces").hint("merge"), "cls")
    buckets = once // TOGETHER + 1

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            grams = [g.view(np.int64) for g in shingle_sets(part["text"].tolist())]
            yield part.drop(columns="text").assign(grams=grams)

    sets = texts.select("text", "cls", "block", "pieces").mapInPandas(with_sets, "cls long, block long, pieces long, grams array<long>")
    piece = F.pmod(F.xxhash64("cls"), F.col("pieces"))
    dealt = sets.withColumn("piece", piece).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = dealt.select("cls", "block", "pieces", "piece", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "grams")
    bucket = F.when(F.col("pieces") > 1, F.xxhash64("block", "i", "j")).otherwise(F.pmod(F.xxhash64("block"), F.lit(buckets)))
    edges = dealt.withColumn("bucket", bucket).drop("pieces").groupBy("bucket").applyInPandas(_join_pieces, "a long, b long")

    linked = connected_components(edges).withColumnRenamed("node", "cls")
    named = stored(firsts.select("cls", "first_id", "held").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = join_facts(named, ids, ["component"]).select("cls", F.col("held").alias("n"), "component", "component_id")
    some = join_facts(rows.where("n > 0").withColumnRenamed("n", "n_shingles"), named, ["cls"]).select("doc_id", "text_hash", "n_shingles", "component_id", "component")
    none = rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return some.unionByName(none)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and more) without near copies: of each component one row, that with the least id.

    Rows without words stay.  A component whose ids are all null keeps the row with the least text hash.
    """
    found = ngram_join(docs)
    lone = found.where("n_shingles = 0").select("doc_id", "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    best = found.where("n_shingles > 0").groupBy("component").agg(first.alias("one")).select("one.doc_id", "one.text_hash")
    keys = best.unionByName(lone).select(F.xxhash64("doc_id", "text_hash").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    # Repeats go before the shuffle of the texts, which serves the join too; the keys are never broadcast.
    kept = rows.dropDuplicates(["key"]).join(keys.hint("merge"), "key", "left_semi")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
