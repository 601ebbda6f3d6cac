"""Licence notices in texts: a sparse word n-gram classifier of paragraphs, confirmed against templates; built-in functions only."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table
from sparkloom.llm.learning import softmax, temperature

UNKNOWN = "unknown"
#: Lines of a window in which wrapped notices are looked for, from one window to the next, and the characters of a line that
#: can be part of one.
WRAPPED = 8
STRIDE = 4
SHORT_LINE = 160
#: A prediction is confirmed if a paragraph holds this share of the n-grams of a template of its family.
CONFIRMED = 0.5
#: Of the held-back notices that are accepted, this share at least has the right family.
ACCEPTED_RIGHT = 0.99

# Fixed texts: short notices as the licences themselves or common usage word them.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "Released under CC0 1.0, dedicated to the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# Fixed texts: paragraphs that share words with notices and are none.
OTHERS = [
    "The committee issued a public statement and the work of the year was described in general terms.",
    "A driving license is needed to use this car; the fee is paid at the office.",
    "Version 3 of the program was released on Monday and version 2 is no longer used.",
    "The software company hired more people for its source code and documentation team.",
    "The library is open to any person, free of charge, and copies of most books can be made.",
    "Our foundation works for the public domain of ideas and for attribution of sources.",
    "The students of MIT met the general under the bridge near the public garden.",
    "This file is large, and the conditions of its storage are described in the following chapter.",
    "Creative people share what they make, and the commons of the village is used by all.",
    "The Apache helicopters flew over the town with or without permission.",
]
STOP = frozenset("a an and any are as at be by for from in is it its may of on or that the this to under use used was were with without you your".split())
_WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    """Words and pairs of neighbours, without those of stop words alone."""
    out = {w for w in words if w not in STOP}
    return out | {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}


class LicenceModel:
    """Multinomial logistic regression over the n-grams of the templates, fitted on varied templates and other paragraphs.

    The families and ``unknown`` are its classes. Every fourth example is held back: it sets the
    temperature, and the probability below which a prediction is unknown after all.
    """

    def __init__(self, templates: list[tuple[str, str]] | None = None, others: list[str] | None = None, copies: int = 40, rounds: int = 400):
        templates = TEMPLATES if templates is None else templates
        others = OTHERS if others is None else others
        self.templates = [(family, sorted(grams_of(words_of(text)))) for family, text in templates]
        self.classes = [UNKNOWN, *sorted({f for f, _ in templates})]
        rng = np.random.default_rng(9)
        plain = sorted({w for t in others for w in words_of(t)})
        known = sorted({w for _, t in templates for w in words_of(t)})
        texts: list[tuple[list[str], int]] = []
        for family, text in templates:
            words = words_of(text)
            for _ in range(copies):
                kept = [w for w in words if rng.random() > rng.choice([0, 0.05, 0.15])] or words
                before, after = ([str(rng.choice(plain)) for _ in range(rng.integers(0, 12))] for _ in range(2))
                texts.append((before + kept + after, self.classes.index(family)))
        for text in others:
            texts += [(words_of(text), 0)] * 4
        for _ in range(len(templates) * copies // 2):
            words = [str(rng.choice(plain)) for _ in range(rng.integers(1, 30))]
            words += [str(rng.choice(known)) for _ in range(rng.integers(0, 4))]
            texts.append(([words[i] for i in rng.permutation(len(words))], 0))
        grams = sorted({g for _, gs in self.templates for g in gs})
        at = {g: i for i, g in enumerate(grams)}
        x = np.zeros((len(texts), len(grams)))
        for row, (words, _) in zip(x, texts):
            row[[at[g] for g in grams_of(words) if g in at]] = 1
        y = np.array([c for _, c in texts])
        held = np.arange(len(y)) % 4 == 3
        k = len(self.classes)
        w, b, target = np.zeros((len(grams), k)), np.zeros(k), np.eye(k)[y[~held]]
        for _ in range(rounds):
            d = (softmax(x[~held] @ w + b) - target) / (~held).sum()
            w -= 4.0 * (x[~held].T @ d)
            # Soft thresholding keeps the weights sparse.
            w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 2e-5, 0)
            b -= 4.0 * d.sum(0)
        logits = x[held] @ w + b
        self.temperature = temperature(logits, y[held])
        p = softmax(logits / self.temperature)
        order = np.argsort(-p[:, 1:].max(1), kind="stable")
        right = np.cumsum((p[:, 1:].argmax(1) + 1 == y[held])[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(right >= ACCEPTED_RIGHT)
        self.accepted = float(max(0.5, p[order[enough[-1]], 1:].max())) if len(enough) else 1.0
        used = np.abs(w).max(1) > 0
        self.weights = {g: [float(v) for v in row] for g, row, u in zip(grams, w, used) if u}
        self.bias = [float(v) for v in b]
        #: The words that any n-gram of the model starts or ends with; a paragraph without them is unknown.
        self.signs = sorted({x for g in self.weights for x in g.split() if x not in STOP})


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _paragraph_scores(paragraphs: Column, model: LicenceModel) -> Column:
    """For each paragraph STRUCT<family, p, share>: the best family with its probability and the share of a template that is there."""
    words = F.transform(paragraphs, lambda p: F.regexp_extract_all(F.lower(p), F.lit(_WORD), F.lit(0)))
    vocabulary = F.array(*[F.lit(g) for g in sorted(model.weights)])

    def present(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_intersect(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))), vocabulary)

    grams = F.transform(words, present)
    weights = F.create_map(*[x for g in sorted(model.weights) for x in (F.lit(g), _doubles(model.weights[g]))])
    add = lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda a, b: a + b)
    logits = F.transform(grams, lambda gs: F.aggregate(gs, _doubles(model.bias), add))
    powers = F.transform(logits, lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / model.temperature)))
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.transform(
        powers,
        lambda e: F.array_max(
            F.zip_with(e, names, lambda v, c: F.struct((v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"), c.alias("family")))
        ),
    )
    known = [(family, [g for g in gs if g in model.weights]) for family, gs in model.templates]
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(g) for g in gs]).alias("grams")) for f, gs in known if gs])

    def confirm(b: Column, gs: Column) -> Column:
        own = F.filter(templates, lambda t: t["family"] == b["family"])
        share = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(gs, t["grams"])) / F.size(t["grams"])))
        return F.struct(b["family"].alias("family"), b["p"].alias("p"), F.coalesce(share, F.lit(0.0)).alias("share"))

    return F.zip_with(best, grams, confirm)


def find_licences(df: DataFrame, model: LicenceModel, text_column: str = "text") -> DataFrame:
    """df with ``__licences``: ARRAY<STRUCT<paragraph, family, p, share, confirmed>> of its licence notices.

    Paragraphs are the lines of the whole text, from 1, and, for notices wrapped over lines, windows of
    WRAPPED lines that overlap by half: their short lines are read as one, so a notice of up to half a
    window's lines and one more is in one window whole. One below the accepted probability, or best
    explained as ``unknown``, isn't a notice; a line whose family has no template that is largely
    there is listed as ``unknown``, unconfirmed. A window counts only if confirmed, under its first
    line, and only for a family that neither a line nor an earlier window of the text has. Texts
    without any word of the model are passed over, which is what their score would say. A null or
    empty text has none.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    signs = F.array(*[F.lit(s) for s in model.signs])
    bare = lambda t: F.split(F.lower(t), "[^a-z0-9.-]+|[.-]+(?![a-z0-9])")
    bearing = lambda x: F.arrays_overlap(bare(x["text"]), signs)
    split = F.split(text, "\n")
    lines = F.filter(F.transform(split, lambda p, i: F.struct((i + 1).alias("at"), p.alias("text"))), bearing)
    out = df.withColumn("__lines", F.when(F.arrays_overlap(bare(text), signs), lines))
    # A window starts at every half, and is read if two of its short lines bear words of the model.
    near = F.filter("__lines", lambda x: F.length(x["text"]) <= SHORT_LINE)
    halves = F.array_distinct(F.flatten(F.transform(near, lambda x: F.array(F.floor((x["at"] - 1) / STRIDE), F.greatest(F.floor((x["at"] - 1) / STRIDE) - 1, F.lit(0))))))
    short = lambda i: F.filter(F.slice(split, i * STRIDE + 1, WRAPPED), lambda p: F.length(p) <= SHORT_LINE)
    windows = F.transform(halves, lambda i: F.struct((i * STRIDE + 1).cast("int").alias("at"), F.array_join(short(i.cast("int")), " ").alias("text")))
    out = out.withColumn("__windows", F.when(F.size(near) > 1, F.array_sort(windows)).otherwise(F.array().cast("array<struct<at:int,text:string>>")))
    row = "struct<paragraph:int,family:string,p:double,share:double,confirmed:boolean>"

    def notices(units: str) -> Column:
        scored = _paragraph_scores(F.transform(units, lambda x: x["text"]), model)
        rows = F.zip_with(units, scored, lambda x, s: F.struct(x["at"].alias("paragraph"), s["family"].alias("family"), s["p"].alias("p"), s["share"].alias("share")))
        rows = F.filter(rows, lambda r: (r["family"] != UNKNOWN) & (r["p"] >= model.accepted))
        named = lambda r: F.when(r["share"] >= CONFIRMED, r["family"]).otherwise(F.lit(UNKNOWN))
        rows = F.transform(rows, lambda r: F.struct(r["paragraph"].alias("paragraph"), named(r).alias("family"), r["p"].alias("p"), r["share"].alias("share"), (r["share"] >= CONFIRMED).alias("confirmed")))
        return F.coalesce(rows, F.array()).cast(f"array<{row}>")

    none = F.array().cast(f"array<{row}>")
    out = out.withColumn("__by_line", F.when(F.col("__lines").isNotNull(), notices("__lines")).otherwise(none))
    out = out.withColumn("__by_window", F.when(F.size("__windows") > 0, F.filter(notices("__windows"), lambda r: r["confirmed"])).otherwise(none))
    known = F.transform("__by_line", lambda r: r["family"])
    new = F.filter("__by_window", lambda r, i: ~F.array_contains(known, r["family"]) & ~F.exists(F.slice("__by_window", 1, i), lambda e: e["family"] == r["family"]))
    return out.withColumn("__licences", F.array_sort(F.concat("__by_line", new))).drop("__lines", "__windows", "__by_line", "__by_window")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, with the paragraph of each notice.

    One row for each document, repeated ones included; a null text has no notice. Of families that
    explain a paragraph equally well the later name counts. An empty table gives no rows.
    """
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), LicenceModel())
    confirmed = F.filter("__licences", lambda r: r["confirmed"])
    written = F.transform("__licences", lambda r: F.concat_ws(":", r["family"], r["paragraph"].cast("string")))
    return found.select(
        "doc_id",
        F.size("__licences").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda r: r["family"]))), ",").alias("families"),
        F.array_join(written, ",").alias("notices"),
        F.coalesce(F.array_max(F.transform("__licences", lambda r: r["p"])), F.lit(0.0)).alias("best_p"),
    )
