"""Operator 4: license scans, by phrases and by an exact set-similarity join with templates.

Base labels: places where the words of a phrase stand consecutively.  Added
labels: every text block whose words hold at least CONTAINMENT of a template's
distinct words.  A template's blocks are all runs of window_words consecutive
words, whatever lines they stand on: its own number of words divided by
CONTAINMENT, so that a wrapped template fits with some words between its own,
and words scattered over a text are no block.  Blocks are first taken together
in overlapping stretches of nearly twice the longest template's window, each
block in one of them; where a stretch passes the filters, every block of it is
counted.  Tokens of the templates are ordered by how many documents hold them,
rarest first.  A stretch can only hold a block that meets a template's threshold
if it holds one of the rarest (size - needed + 1) tokens (prefix filter), enough
template tokens at all (length filter), and enough of them from the place of the
shared token on (position filter); what passes is counted exactly.  Templates
are a parameter of bounded size, so their side is broadcast; the blocks are not
shuffled.

Defined results: a null text counts as empty; a text without words has no
places, null first and last words, empty labels and score 0; equal rows stay as
many rows and rows with the same id and different texts are told apart; other
columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases and their labels (fixed values of the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and permissions of well-known licenses (fixed values: public texts).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """Lower case.  Only ASCII words are compared, so of other letters only the Kelvin sign, whose lower case is k, must be kept apart."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("κ")))


def _normal(lowered: Column) -> Column:
    """Words joined by single spaces; every character outside words ends one."""
    return F.trim(F.regexp_replace(lowered, _BREAKS, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words(text: str) -> list[str]:
    return re.sub(_BREAKS, " ", text.lower()).split()


def _counted(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_found (labels) from _normal."""
    docs = docs.withColumn("_padded", F.concat(F.lit(" "), "_normal", F.lit(" ")))
    docs = docs.withColumn("n_words", F.when(F.col("_normal") == "", 0).otherwise(_spaces(F.col("_normal")) + 1).cast("long"))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        has = F.col("_padded").contains(f" {phrase} ")
        parts = F.split(F.col("_padded"), f"(?<= )(?={phrase} )", -1)
        places.append(F.when(has, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(has, _spaces(F.get(parts, 0)) - 1))
        lasts.append(F.when(has, F.col("n_words") - _spaces(F.element_at(parts, -1))))
        labels.append(F.when(has, F.lit(label)))
    least, most = (firsts[0], lasts[0]) if len(phrases) == 1 else (F.least(*firsts), F.greatest(*lasts))
    return docs.select(
        "*",
        sum(places[1:], places[0]).cast("long").alias("n_base"),
        least.cast("long").alias("first_word"),
        most.cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_found"),
    )


def token_frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many documents each of the given tokens stands; as many rows reach the driver as tokens are given."""
    held = F.array_intersect(F.split(_normal(_lowered(F.coalesce("text", F.lit("")))), " "), F.array(*map(F.lit, tokens)))
    counts = docs.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return {r.token: r.n for r in counts.collect()}


def window_words(template: str, containment: float = CONTAINMENT) -> int:
    """Words of a template's blocks: its own, with room for others between them."""
    return math.ceil(len(_words(template)) / containment - 1e-9)


def template_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, label, containment) of each document's blocks that meet a template's threshold."""
    spark = docs.sparkSession
    universe = sorted({w for _, t in templates for w in _words(t)})
    frequency = token_frequencies(docs, universe)
    order = sorted(universe, key=lambda w: (frequency.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    sets, prefixes = [], []
    for k, (label, t) in enumerate(templates):
        tokens = sorted(set(_words(t)), key=at.__getitem__)
        needed = math.ceil(containment * len(tokens) - 1e-9)
        sets.append((k, label, tokens, window_words(t, containment)))
        prefixes += [(w, k, i, len(tokens), needed) for i, w in enumerate(tokens[: len(tokens) - needed + 1])]
    index = spark.createDataFrame(prefixes, "token string, template int, place int, size int, needed int")
    wanted = spark.createDataFrame(sets, "template int, label string, tokens array<string>, width int")
    rare = sorted({p[0] for p in prefixes})
    least_needed, widest = min(p[4] for p in prefixes), max(s[3] for s in sets)

    holds = functools.reduce(operator.or_, (F.col("_low").contains(w) for w in rare))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _lowered(F.col("text")).alias("_low")).where(holds)
    rows = rows.select("doc_id", "text_hash", F.split(_normal(F.col("_low")), " ").alias("_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - widest, F.lit(0)) + 1, F.lit(widest))
    has_rare = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, rare)))
    stretches = F.filter(F.transform(starts, lambda i: F.slice("_words", i, 2 * widest - 1)), has_rare)
    blocks = rows.select("doc_id", "text_hash", F.explode(stretches).alias("words"))
    # array_intersect keeps the order of its first array: rarest token first.
    blocks = blocks.select("*", F.array_intersect(F.array(*map(F.lit, order)), F.col("words")).alias("held"))
    blocks = blocks.where(F.size("held") >= least_needed)
    prefix = F.slice("held", 1, F.size("held") - least_needed + 1)
    shared = blocks.select("*", F.posexplode(prefix).alias("held_place", "token")).join(F.broadcast(index), "token")
    shared = shared.where(F.size("held") >= F.col("needed")).where(1 + F.least(F.size("held") - F.col("held_place"), F.col("size") - F.col("place")) - 1 >= F.col("needed"))
    found = shared.join(F.broadcast(wanted), "template").where(F.size(F.array_intersect("held", "tokens")) >= F.col("needed"))
    # Once for each template of a stretch, whatever number of its tokens led there.
    first = F.array_min(F.transform(F.array_intersect("tokens", prefix), lambda w: F.array_position("held", w)))
    found = found.where(F.col("held_place") + 1 == first)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("width"), F.lit(0)) + 1), lambda i: F.size(F.array_intersect("tokens", F.slice("words", i, F.col("width")))))
    found = found.withColumn("overlap", F.array_max(windows))
    return found.where(F.col("overlap") >= F.col("needed")).select("doc_id", "text_hash", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: counts and places of the phrases, labels of phrases and of templates, score.

    The score is 1 where a phrase stands, else the highest containment found, else 0.
    """
    found = template_matches(docs, templates, containment).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "more", "most")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _normal(_lowered(F.coalesce("text", F.lit("")))).alias("_normal"))
    own = _counted(own, phrases).drop("_normal", "_padded")
    both = own.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & F.col("text_hash").eqNullSafe(F.col("found_hash")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base_found")).alias("base_labels"),
        joined(F.concat("base_found", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
