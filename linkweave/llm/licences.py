"""Find licence statements in texts with DataFrame operations only.

A logistic regression over sparse word n-grams tells licence families and the
class ``unknown`` apart.  It is trained on the templates below, on cut and
joined variants of them, on counter-examples that use the same words, and on
notices of families that have no template; other variants, counter-examples and
such families, held out from training, fit the temperature that calibrates its
probabilities.  Training takes a few seconds on the driver, over these fixed
texts alone.  The scan is native: paragraphs that hold a keyword are cut into
n-grams, joined with the weights (at most ``MAX_FEATURES`` rows, broadcast),
summed, and turned into probabilities; a prediction counts if the family's
probability reaches ``CONFIDENCE`` and one of the family's templates confirms
it: the paragraph holds ``CONTAINED`` of the template's n-grams and, if the
template has words that no other family's templates have, one of those.

Keywords only spare work: so many words of each template are keywords that its
n-grams without any of them are fewer than ``CONTAINED`` of all, so that no
paragraph without a keyword can be confirmed.

Defined cases: a null or empty text has no licence; texts of any length are read
whole; a paragraph is a single line, or a run of lines between lines without
letters and digits, which is named by its first line and counts where no line of
it gives the same family; every input row gives one row, rows with equal id and
text give equal ones; an empty table gives no rows; further columns, whatever
their names, are ignored; ties between families go to the first by name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import table

MAX_FEATURES = 8_192
CONFIDENCE = 0.6
#: Share of a template's n-grams that a paragraph must hold.
CONTAINED = 0.6
UNKNOWN = "unknown"
#: Keywords with fewer letters are looked for as words only.
SHORT = 4

# One or more statements of each family.
TEMPLATES = {
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0", "You can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0."),
    "epl": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.", "SPDX-License-Identifier: EPL-2.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "You can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0", "Released under the GPL version 3."),
    "isc": ("Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0", "You can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or at your option any later version."),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This source code is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright the authors. All rights reserved.", "No part of this publication may be reproduced without written permission of the publisher."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
}
# Statements that use the words of licences without being one.
COUNTER = (
    "The driver showed a licence and a permit to the officer.",
    "He teaches public policy at MIT and was a professor there.",
    "The apache helicopter landed near the village.",
    "The poem takes artistic license with the facts.",
    "She was granted permission to use the car for any purpose.",
    "The general public was not admitted to the hearing.",
    "A licensed dealer sells version 2.0 of the machine.",
    "The warranty of this product ends after two years.",
    "The book was released under a new title in the following year.",
    "The terms of the agreement were published by the ministry.",
    "Copyright law was reformed under the new government.",
    "The software is free of charge for students.",
    "The rights of the author were reserved for the heirs.",
    "Creative people use the commons in the public domain of the town.",
    "The foundation published a general report on public health, version 3.",
    "International attribution of the work remained unknown.",
    "Licensed under the house license of the vendor.",
    "Released under the terms of a license agreement, version 1.",
    "This work is licensed under a private agreement.",
)
# Notices of families without a template; the second half is held out.
OTHERS = (
    "Licensed under the Artistic License 2.0.",
    "Released under the zlib License.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Distributed under the Boost Software License, version 1.0.",
    "Licensed under the Academic Free License, version 3.0.",
    "This work is licensed under the SIL Open Font License, version 1.1.",
    "Released under the Do What The Fuck You Want To Public License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Microsoft Public License.",
    "Released under the PostgreSQL License.",
    "Licensed under the Open Software License, version 3.0.",
    "This work is licensed under the Open Government Licence, version 3.0.",
    "Released under the Python Software Foundation License.",
    "Licensed under the IBM Public License, version 1.0.",
)
# Words that are usual in other texts, which make poor keywords.
USUAL = frozenset("a all an author available copy extent fee mit option v and any are as at be been by code file for free from general has have he in into is it law made may met no not of on or part person public purpose she software source terms that the this to under use was which with without work you your".split())
WORDS = r"[a-z0-9]+"


def ngrams_of(text: str) -> list[str]:
    """Distinct 1- to 3-grams of the lower-cased words of ASCII letters and digits."""
    import re

    w = re.findall(WORDS, text.lower())
    return sorted({" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def _ngrams(text: Column) -> Column:
    """The same as a column."""

    def of(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    words = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return _let(words, lambda w: F.array_distinct(F.concat(of(w, 1), of(w, 2), of(w, 3))))


def _variants(held_out: bool) -> list[tuple[str, str]]:
    """Statements with their class: whole, between other words, and joined with counter-examples."""
    out = []
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            other = COUNTER[(3 * i + len(family) + held_out) % len(COUNTER)]
            words = text.split()
            forms = [f"{other} {text}", f"Note. {text} See below."] if held_out else [text, f"{text} {other}", " ".join(words[1:]) if len(words) > 5 else text, " ".join(words[:-1]) if len(words) > 5 else text]
            out += [(x, family) for x in forms]
    halves = [" ".join(x.split()[: len(x.split()) // 2]) for x in COUNTER]
    half = len(OTHERS) // 2
    out += [(x, UNKNOWN) for x in (OTHERS[half:] if held_out else OTHERS[:half])]
    out += [(x, UNKNOWN) for x in (halves if held_out else [*COUNTER, *(f"{a} {b}" for a, b in zip(COUNTER, COUNTER[1:], strict=False))])]
    return out


@cache
def keywords() -> tuple[str, ...]:
    """Words without which no template can be contained: of each template those in most n-grams, as many as that takes."""
    out: set[str] = set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        grams = [g.split() for g in ngrams_of(text)]
        while len(bare := [g for g in grams if out.isdisjoint(g)]) >= CONTAINED * len(grams):
            words = {w for g in bare for w in g}
            out.add(min(words, key=lambda w: (w in USUAL or w.isdigit(), len(w) < SHORT, -sum(w in g for g in bare), w)))
    return tuple(sorted(out))


@cache
def names() -> dict[str, frozenset[str]]:
    """Words of each family's templates that are in no other family's and in no counter-example."""
    words = {f: {w for t in ts for w in ngrams_of(t) if " " not in w} for f, ts in TEMPLATES.items()}
    common = {w for t in (*COUNTER, *OTHERS) for w in ngrams_of(t)}
    return {f: frozenset(ws - common - set().union(*(o for g, o in words.items() if g != f))) for f, ws in words.items()}


@cache
def train() -> tuple[tuple[str, ...], tuple[str, ...], np.ndarray, np.ndarray, float]:
    """(classes, features, weights, bias, temperature)."""
    data = [(set(ngrams_of(x)), c) for x, c in _variants(False)]
    classes = (*sorted(TEMPLATES), UNKNOWN)
    count: dict[str, int] = {}
    for grams, _ in data:
        for g in grams:
            count[g] = count.get(g, 0) + 1
    features = tuple(sorted(count, key=lambda g: (-count[g], g))[:MAX_FEATURES])
    at = {g: i for i, g in enumerate(features)}

    def matrix(rows) -> np.ndarray:
        x = np.zeros((len(rows), len(features)))
        for i, (grams, _) in enumerate(rows):
            x[i, [at[g] for g in grams if g in at]] = 1
        return x

    x, y = matrix(data), np.eye(len(classes))[[classes.index(c) for _, c in data]]
    w, b = np.zeros((len(features), len(classes))), np.zeros(len(classes))
    b[-1] = 2.0  # what holds no feature at all is unknown

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(250):
        error = (softmax(x @ w + b) - y) / len(y)
        w -= 4.0 * (x.T @ error + 1e-4 * w)
        b[:-1] -= 4.0 * error.sum(axis=0)[:-1]
    held = [(set(ngrams_of(t)), c) for t, c in _variants(True)]
    z, t = matrix(held) @ w + b, [classes.index(c) for _, c in held]
    loss = lambda heat: -np.log(softmax(z / heat)[np.arange(len(t)), t] + 1e-12).mean()
    heat = min(np.linspace(1, 4, 31), key=loss)
    return classes, features, w, b, float(heat)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_licences, families, lines and least confidence."""
    spark = docs.sparkSession
    classes, features, w, b, heat = train()
    weights = F.broadcast(spark.createDataFrame([(g, [float(v) for v in row]) for g, row in zip(features, w / heat, strict=True)], "gram string, w array<double>"))
    forms = [(f, i, ngrams_of(t)) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    templates = F.broadcast(spark.createDataFrame([(f, i, len(gs), names()[f].isdisjoint(gs), g in names()[f], g) for f, i, gs in forms for g in gs], "family string, form int, form_size int, nameless boolean, name boolean, gram string"))
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    lines = base.filter(_any(F.col("text"))).select("doc_id", "hash", F.explode(_paragraphs(F.split("text", "\n", -1))).alias("p")).select("doc_id", "hash", "p.*")
    key = ["doc_id", "hash", "line", "last"]
    grams = lines.distinct().select(*key, F.explode(_ngrams(F.col("paragraph"))).alias("gram"))
    scores = grams.join(weights, "gram").groupBy(*key).agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(classes))])
    z = [F.col(f"z{i}") + F.lit(float(v)) for i, v in enumerate(b / heat)]
    top = F.greatest(*z)
    best = F.coalesce(*[F.when(x == top, F.lit(c)) for c, x in zip(classes, z, strict=True)])
    share = 1 / sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    found = scores.select(*key, best.alias("family"), share.alias("confidence")).filter((F.col("family") != UNKNOWN) & (F.col("confidence") >= CONFIDENCE))
    held = grams.join(templates, "gram").groupBy(*key, "family", "form", "form_size").agg(F.count("*").alias("n"), F.bool_or(F.col("nameless") | F.col("name")).alias("named")).filter((F.col("n") >= CONTAINED * F.col("form_size")) & F.col("named"))
    held = held.groupBy(*key, "family").agg(F.max(F.col("n") / F.col("form_size")).alias("contained"))
    sure = found.alias("f").join(held.alias("h"), _same("f", "h", [*key, "family"])).select(*[F.col(f"f.{c}") for c in (*key, "family", "confidence")])
    each = sure.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("line", "last", "family", "confidence")).alias("all"))
    own = lambda x: F.filter("all", lambda o: (o["line"] == o["last"]) & (o["family"] == x["family"]) & o["line"].between(x["line"], x["last"]))
    each = each.withColumn("hits", F.filter("all", lambda x: (x["line"] == x["last"]) | (F.size(own(x)) == 0)))
    each = each.select("doc_id", "hash", F.size("hits").alias("n"), F.array_sort(F.array_distinct("hits.family")).alias("families"), F.array_sort("hits.line").alias("lines"), F.array_min("hits.confidence").alias("confidence"))
    out = base.select("doc_id", "hash").alias("f").join(each.alias("h"), _same("f", "h", ["doc_id", "hash"]), "left")
    return out.select("f.doc_id", F.coalesce("h.n", F.lit(0)).cast("long").alias("n_licences"), F.array_join("h.families", ",").alias("families"), F.array_join("h.lines", ",").alias("lines"), F.round("h.confidence", 6).alias("confidence"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _paragraphs(text: Column) -> Column:
    """(line, last, paragraph) of each line and each run of several lines, where a keyword is in it."""
    row = lambda a, b, x: F.struct(a.alias("line"), b.alias("last"), x.alias("paragraph"))

    def of(lines: Column, full: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        starts = F.filter(at, lambda i: F.get(full, i) & ~F.coalesce(F.get(full, i - 1), F.lit(False)))
        ends = F.filter(at, lambda i: F.get(full, i) & ~F.coalesce(F.get(full, i + 1), F.lit(False)))
        runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["a"] < r["b"])
        runs = F.transform(runs, lambda r: row(r["a"], r["b"], F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), " ")))
        return F.filter(F.concat(F.transform(lines, lambda x, i: row(i, i, x)), runs), lambda p: _let(F.lower(p["paragraph"]), _any))

    return _let(text, lambda lines: _let(F.transform(lines, lambda x: F.lower(x).rlike("[a-z0-9]")), lambda full: of(lines, full)))


def _any(text: Column) -> Column:
    """Whether a keyword is in the text, a short one as a word."""
    low = F.lower(text)
    first, *rest = [k for k in keywords() if len(k) >= SHORT]
    out = F.contains(low, F.lit(first))
    for k in rest:
        out = out | F.contains(low, F.lit(k))
    short = [k for k in keywords() if len(k) < SHORT]
    return out | low.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])")


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
