"""Licence scans: a sparse word n-gram paragraph classifier in DataFrame operations.

Paragraphs are the lines of a text.  A multinomial logistic regression over distinct
word 1- and 2-grams gives each a licence family, ``unknown`` (licensing language
of no known family) or ``none``.  It is trained on the driver from the notice
templates below, altered and embedded in running text, and on a documented, bounded
sample of ordinary paragraphs.  Its temperature is fitted on a quarter of the examples
kept back, and a family needs at least ``SURE`` of the calibrated probability; a
licensing paragraph below that is ``unknown``.  A family counts as confirmed if the paragraph
holds enough of the word 3-grams of one of its templates; else it is ``unknown`` too.

A notice can be wrapped over lines: runs of lines without a blank line between (one without
letters and digits, as of comment marks alone) are joined and scanned the same way, and a
confirmed run counts once in n_license if no single line of the text is confirmed for its
family.  A run has one family, its likeliest; n_unknown counts single lines, of wrapped notices too.

Scoring is DataFrame operations only.  A paragraph can only be licensing if it has an
n-gram that speaks for it; one regular expression of all of them passes over every whole
text and then over the lines of those that match, and what does not match is ``none``,
exactly.  The others are cut into words; of them only numbers are shuffled, one row per
paragraph and task.

Defined cases: null and empty texts have no paragraphs.  Blank lines are not counted.
Rows repeated with id and text get the same result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The usual notices by which texts name these licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright (c) 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
UNKNOWN = [
    "Licensed under the terms of the license agreement.",
    "See the LICENSE file for license terms.",
    "This work is distributed under a license of its own.",
    "Use of this text is subject to the license that came with it.",
    "Released under the terms of the community license, version 1.",
    "The license of this document permits copying.",
]
ORDINARY = [
    "He lost his driving license on the way to the office.",
    "The general public was free to use the source of the river.",
    "The version of the story that the foundation published is free of charge.",
    "All people have rights, and the law must respect them.",
    "The software was released in version 2 last year.",
    "A copy of the file is on the table under the lamp.",
    "The public library is free for any person.",
    "Creative work is common in the public domain of ideas.",
]
CLASSES = ["none", "unknown", *TEMPLATES]
SURE = 0.6
#: Share of a template's 3-grams that a paragraph must hold.
CONFIRM = 0.6
#: N-grams in a greater share of ordinary paragraphs are no features.
COMMON = 0.005
SAMPLE_TEXTS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 300, 3000, 20_000


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def triples_of(words: list[str]) -> set[str]:
    """3-grams, or the whole of a shorter template."""
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _pattern(grams: set[str]) -> str | None:
    """A regular expression for lower-cased text that finds any of some word n-grams, as a tree of their characters."""
    tree: dict = {}
    for g in sorted(grams):
        at = tree
        for c in g:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(node: dict) -> str:
        some = ["(?![a-z0-9])" if c == "" else ("[^a-z0-9]+" if c == " " else c) + of(node[c]) for c in sorted(node)]
        return some[0] if len(some) == 1 else f"(?:{'|'.join(some)})" if some else ""

    return "(?<![a-z0-9])" + of(tree) if tree else None


class Model:
    """Weights of n-grams by class relative to ``none``, biases, temperature, and the pattern that any licensing paragraph matches."""

    def __init__(self, grams: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.grams, self.weights, self.bias, self.temperature = grams, weights, bias, temperature
        gain = weights[:, 1:].max(axis=1) if len(grams) else np.zeros(0)
        speaking = {g for g, x in zip(grams, gain, strict=True) if x > 0}
        #: The n-grams that speak for any licence, shorter ones for longer ones that hold them.
        self.needed = {g for g in speaking if " " not in g or not speaking & set(g.split())}
        #: Whether a paragraph without any of them is ``none``, whose bias then is the greatest; if not, every paragraph is scored.
        self.decides = bool((bias[1:] < 0).all())

    def among(self, text: Column) -> Column:
        """Whether a lower-cased text can hold a licensing paragraph."""
        if not self.decides:
            return F.lit(True)
        pattern = _pattern(self.needed)
        return F.lit(False) if pattern is None else F.regexp_like(text, F.lit(pattern))

    def probabilities(self, text: str) -> np.ndarray:
        """The plain form of what the DataFrame plan computes, for tests."""
        at = {g: k for k, g in enumerate(self.grams)}
        z = self.bias + sum((self.weights[at[g]] for g in grams_of(words_of(text)) if g in at), np.zeros(len(self.bias)))
        z = z / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def _examples(ordinary: list[str], rng: np.random.Generator, each: int = 40) -> tuple[list[set], list[int]]:
    filler = [w for p in ordinary for w in words_of(p)] or ["text"]
    out: list[tuple[list[str], int]] = [(words_of(p), 0) for p in ordinary]
    out += [(words_of(p), 0) for p in ORDINARY for _ in range(each // 2)]

    def some() -> list[str]:
        n = int(rng.choice([0, 0, 3, 10, 60]))
        at = int(rng.integers(0, max(1, len(filler) - n)))
        return filler[at : at + n]

    for k, name in enumerate(CLASSES[1:], 1):
        for template in TEMPLATES.get(name, UNKNOWN):
            words = words_of(template)
            for i in range(each):
                drop = 0.08 * (i % 3) if len(words) > 8 else 0.0
                out.append(([*some(), *(w for w in words if rng.random() >= drop), *some()], k))
    return [grams_of(w) for w, _ in out], [k for _, k in out]


def fit(ordinary: list[str], seed: int = 10, steps: int = 250) -> Model:
    """Penalised maximum likelihood on three quarters of the examples, temperature on the rest."""
    rng = np.random.default_rng(seed)
    known = [triples_of(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    ordinary = [p for p in ordinary if not any(len(t & triples_of(words_of(p))) >= CONFIRM * len(t) for t in known)]
    sets, labels = _examples(ordinary, rng)
    grams = sorted({g for s, k in zip(sets, labels, strict=True) if k for g in s} & {g for t in [*UNKNOWN, *ORDINARY, *(t for ts in TEMPLATES.values() for t in ts)] for g in grams_of(words_of(t))})
    common: dict[str, int] = {}
    for p in ordinary:
        for g in grams_of(words_of(p)):
            common[g] = common.get(g, 0) + 1
    grams = [g for g in grams if common.get(g, 0) <= COMMON * len(ordinary)]
    at = {g: k for k, g in enumerate(grams)}
    x = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [at[g] for g in s if g in at]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[labels]
    kept = rng.random(len(sets)) < 0.25
    share = 1 / np.maximum(y[~kept].sum(axis=0), 1)
    weight = (y[~kept] @ share)[:, None]
    weight = (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros((len(grams), len(CLASSES)), dtype=np.float32), np.zeros(len(CLASSES), dtype=np.float32)
    b[0] = 4.0
    xs, ys = x[~kept], y[~kept]
    m, v = np.zeros((len(grams) + 1, len(CLASSES)), dtype=np.float32), np.zeros((len(grams) + 1, len(CLASSES)), dtype=np.float32)
    for k in range(1, steps + 1):
        z = xs @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - ys) * weight
        grad = np.vstack([xs.T @ d + 1e-5 * w, d.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) * min(1.0, 2 * (1 - k / (steps + 1)))
        w, b = (w - step[:-1]).astype(np.float32), (b - step[-1]).astype(np.float32)
    w, b = (w - w[:, :1]).astype(float), (b - b[0]).astype(float)
    w[np.abs(w).max(axis=1) < 0.05] = 0
    z, best = x[kept] @ w + b, (np.inf, 1.0)
    for t in np.geomspace(0.25, 4, 33):
        p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = min(best, (float(-np.log(np.maximum((p * y[kept]).sum(axis=1), 1e-9)).mean()), float(t)))
    some = np.abs(w).max(axis=1) > 0
    return Model([g for g, s in zip(grams, some, strict=True) if s], w[some], b, best[1])


def train(docs: DataFrame, seed: int = 10) -> Model:
    """A model with ordinary paragraphs from a bounded, hash-spread sample of texts."""
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    n = usable.count()
    share = min(1.0, SAMPLE_TEXTS / max(1, n))
    place = F.xxhash64("text").alias("place")
    picked = usable.where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30))).select("text", place).distinct().orderBy("place", "text").limit(4 * SAMPLE_TEXTS).collect()
    lines = sorted({p for r in picked for p in r["text"].split("\n") if p.strip()})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(lines))[:SAMPLE_PARAGRAPHS]
    return fit([lines[i] for i in sorted(order.tolist())], seed)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, h, line, kind, p, confirmed) of every line that is not ``none``; h hashes the text."""
    return _scan(docs, model).where("NOT run").drop("run")


def wrapped(docs: DataFrame, model: Model) -> DataFrame:
    """The same of every confirmed run of two or more lines without a blank line between, joined; line numbers the runs."""
    return _scan(docs, model).where("run AND confirmed").drop("run")


def _anchors() -> set[str]:
    """3-grams of which a paragraph that holds enough of any template has at least one.

    It can lack only so many of a template's 3-grams, so of any larger number of them it has one; the longest are taken.
    """
    out: set[str] = set()
    for t in (triples_of(words_of(t)) for ts in TEMPLATES.values() for t in ts):
        out.update(sorted(t, key=lambda g: (-len(g), g))[: len(t) - math.ceil(CONFIRM * len(t)) + 1])
    return out


def _parts(lines: Column) -> Column:
    """The lines of a text, and after them its runs of two or more lines between blank ones."""
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.regexp_like(x, F.lit(r"[\p{L}\p{N}]")), x).otherwise(F.lit(""))), "\n")
    runs = F.transform(F.split(marked, "\n\n+"), lambda x, i: F.struct(F.lit(True).alias("run"), i.alias("line"), x.alias("p")))
    several = F.filter(runs, lambda r: F.regexp_like(r["p"], F.lit(r"[^\n]\n[^\n]")) & F.regexp_like(r["p"], F.lit(_pattern(_anchors()))))
    return F.concat(F.transform(lines, lambda x, i: F.struct(F.lit(False).alias("run"), i.alias("line"), x.alias("p"))), several)


def _once(rows: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """``rows`` with more columns, each worked out once: a plain column is copied by the optimiser into each expression that uses it."""
    return rows.select(*keep, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in more.items()]))))


def _scan(docs: DataFrame, model: Model) -> DataFrame:
    """(run, doc_id, h, line, kind, p, confirmed) of lines that are not ``none`` and of runs that hold enough of a template."""
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").where(model.among(F.lower("text")))
    rows = _once(rows, ["doc_id"], h=F.xxhash64("text"), lines=F.split(F.lower("text"), "\n"))
    # outer, as else the parts are worked out once more to see that there are some
    rows = rows.select("doc_id", "h", F.explode_outer(_parts(F.col("lines"))).alias("part")).select("doc_id", "h", "part.*").where(model.among(F.col("p")))
    keys = ["run", "doc_id", "h", "line"]
    rows = _once(rows, keys, w=_words(F.col("p")))
    pair = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    rows = _once(rows, [*keys, "w"], pair=pair)
    # whole arrays side by side: a lambda over positions would cut the text into words again at each
    each = F.zip_with(F.slice("pair", F.lit(1), F.size("w") - 2), F.slice("w", F.lit(3), F.size("w") - 2), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.when(F.size("w") > 2, each).otherwise(F.array(F.array_join("w", " ")))
    every = sorted({g for ts in TEMPLATES.values() for t in ts for g in triples_of(words_of(t))})
    grams = F.array_intersect(F.concat("w", "pair"), F.array(*[F.lit(g) for g in model.grams]).cast("array<string>"))
    rows = _once(rows, keys, grams=grams, triples=F.array_intersect(triples, F.array(*[F.lit(g) for g in every])))
    held = F.lit(0).cast("long")  # a bit per family one of whose templates the paragraph holds
    for k, name in enumerate(CLASSES[2:]):
        some = F.lit(False)
        for t in sorted({tuple(sorted(triples_of(words_of(t)))) for t in TEMPLATES[name]}):
            some = some | (F.size(F.array_intersect(F.array(*[F.lit(g) for g in t]), "triples")) >= CONFIRM * len(t))
        held = held + F.when(some, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    names = [f"z{k}" for k in range(len(CLASSES))]
    # the empty n-gram counts how often a repeated row has the paragraph
    table = [("", 1, *[0.0] * len(CLASSES)), *((g, 0, *map(float, w)) for g, w in zip(model.grams, model.weights, strict=True))]
    table = spark.createDataFrame(table, "gram string, one int, " + ", ".join(f"{n} double" for n in names))
    rows = rows.withColumn("held", held).where("NOT run OR held <> 0")
    rows = rows.select("run", "doc_id", "h", "line", "held", F.explode(F.concat(F.array(F.lit("")), "grams")).alias("gram"))
    hits = rows.join(F.broadcast(table), "gram")  # one row per template n-gram
    z = hits.groupBy("run", "doc_id", "h", "line").agg(F.max("held").alias("held"), F.sum("one").alias("n"), *[F.sum(n).alias(n) for n in names])
    z = z.withColumn("zs", F.array(*[(F.col(x) / F.col("n") + float(model.bias[k])) / model.temperature for k, x in enumerate(names)])).withColumn("top", F.array_max("zs"))
    z = z.withColumn("total", F.aggregate("zs", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top"))))
    z = z.withColumn("at", F.array_position("zs", F.col("top")).cast("int")).withColumn("p", 1 / F.col("total")).where("at > 1")
    confirmed = F.expr("at > 2 AND (held & shiftleft(1L, greatest(at - 3, 0))) <> 0") & (F.col("p") >= SURE)
    z = z.withColumn("confirmed", confirmed)
    kind = F.when(F.col("confirmed"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("at"))).otherwise(F.lit("unknown"))
    return z.select("run", "doc_id", "h", "line", kind.alias("kind"), "p", "confirmed")


def licenses(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_license, n_unknown, licenses (confirmed families, sorted, comma-joined), score (the surest)."""
    both = settle(_scan(docs, model).where("NOT run OR confirmed"))
    known = both.where("NOT run AND confirmed").select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), F.col("kind").alias("k_")).distinct()
    more = both.where("run").join(known, (F.col("h") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("kind") == F.col("k_")), "left_anti")
    found = both.where("NOT run").unionByName(more)
    named = found.groupBy("doc_id", "h").agg(
        F.sum(F.col("confirmed").cast("long")).alias("n_license"),
        F.sum((~F.col("confirmed")).cast("long")).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("kind")))), ",").alias("licenses"),
        F.max(F.when(F.col("confirmed"), F.col("p"))).alias("score"),
    )
    blank = F.coalesce(F.regexp_count("text", F.lit(r"\S[^\n]*")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), blank.alias("n_paragraphs"))
    named = named.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "n_license", "n_unknown", "licenses", "score")
    out = rows.join(named, (F.col("h") == F.col("h_")) & F.col("doc_id").eqNullSafe(F.col("d_")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_license", zero).alias("n_license"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("score", F.lit(0.0)).alias("score"))
