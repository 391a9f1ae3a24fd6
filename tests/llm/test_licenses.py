import random
import re

from tidewatch.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    words = re.findall(WORD, lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    more, most = windows(words)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if places else most


def windows(words):
    """Labels and the highest containment over every window of words of each template's width."""
    more, most = set(), 0.0
    for label, t in licenses.TEMPLATES:
        want, width = set(re.findall(WORD, lowered(t))), licenses.window_words(t)
        for i in range(max(len(words) - width, 0) + 1):
            share = len(want.intersection(words[i : i + width])) / len(want)
            if share >= licenses.CONTAINMENT - 1e-9:
                more.add(label)
                most = max(most, share)
    return more, most


def test_equals_plain_scan(spark, tmp_path):
    rnd = random.Random(3)
    bits = ["cc by", "CC-BY 4.0", "cc", "by", "General Public License", "all rights reserved", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "\n", " ", "é", "K", "word", "the", "license", "\x00", "Licensed under CC BY-NC 4.0", licenses.TEMPLATES[1][1], licenses.TEMPLATES[1][1].replace("charge", "")]
    texts = [None, "", "   ", "cc by cc by", "ALL RIGHTS RESERVED", "all rights reserved", *(" ".join(rnd.choices(bits, k=rnd.randint(0, 25))) for _ in range(500))]
    rows = [*enumerate(texts), (None, "cc by"), (3, "other text under the same id"), (4, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op4_licenses(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    want = sorted(((i, *plain(t)[:6], round(plain(t)[6], 9)) for i, t in rows), key=key)
    assert sorted(((*r[:7], round(r.score, 9)) for r in got), key=key) == want


def test_wrapped_templates_equal_plain_windows(spark):
    import textwrap

    rnd = random.Random(4)
    filler = "some other words of the text stand here before and after a license under which it comes".split()
    texts, whole = [], 0
    for label, t in licenses.TEMPLATES:
        for width in (72, 24):
            for mark in ("", " * ", "# "):
                for before in (0, 1, 30, 31, 32, 33, 64, 200):
                    body = " ".join([*rnd.choices(filler, k=before), t, *rnd.choices(filler, k=rnd.randint(0, 60))])
                    texts.append((label, "\n".join(mark + x for x in textwrap.wrap(body, width))))
                    whole += 1
    for _ in range(400):  # scattered, shortened and stretched ones
        label, t = rnd.choice(licenses.TEMPLATES)
        body = [w for w in t.split() if rnd.random() > 0.05]
        for _ in range(rnd.randint(0, 12)):
            body.insert(rnd.randint(0, len(body)), rnd.choice(filler))
        texts.append((None, "\n".join(textwrap.wrap(" ".join([*rnd.choices(filler, k=rnd.randint(0, 90)), *body, *rnd.choices(filler, k=rnd.randint(0, 40))]), 40))))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (set(filter(None, r.labels.split(","))) - set(filter(None, r.base_labels.split(","))), r.n_base, r.score) for r in licenses.scan(df).collect()}
    for i, (label, text) in enumerate(texts):
        more, most = windows(re.findall(WORD, lowered(text)))
        base = set(plain(text)[4].split(","))
        assert got[i][0] == more - base, text
        assert got[i][1] or abs(got[i][2] - most) < 1e-9, text
        if i < whole:
            assert label in more


def test_scattered_words_are_no_block(spark):
    """The words of a template, far apart in a long line."""
    words = " ".join(f"{w} {'x ' * 200}" for w in licenses.TEMPLATES[1][1].split())
    long = "word " * 400_000 + licenses.TEMPLATES[2][1] + " word" * 400_000
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame([(1, words), (2, long)], "doc_id long, text string")).collect()}
    assert got == {1: ("", 0.0), 2: ("mit", 1.0)}


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
