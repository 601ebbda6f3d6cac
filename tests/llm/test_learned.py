"""Operators that learn: held-out accuracy on generated tables, defined results for odd rows."""

import random
import wave
import io
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import audio, langid, licenses, mixing, quality, toxicity
from tests.llm.test_exact import LONG, SCHEMA, docs_of, write

LETTERS = {"xx": ["ba", "do", "ri", "na", "so"], "yy": ["ück", "sch", "ein", "ung", "ver"]}


def words(rng, lang, n):
    return ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    docs, labels = [(9001, None, None, "s", 0), (9002, "", "xx", "s", 0), (9003, "12 !! 34", "yy", "s", 8), (9004, LONG, None, "s", len(LONG)), (None, "ba do", "xx", "s", 5)], []
    for i in range(700):
        lang = rng.choice(["xx", "yy"])
        w = words(rng, lang, rng.randrange(20, 90))
        toxic, poor = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbler", "snarkface", "vilething", "grumbIer" if rng.random() < 0.2 else "grumbler"]))
        if poor:
            w = [x.upper() + "!!" for x in w]
        text = " ".join(w)
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, int(not poor), int(toxic)))
    labels += [(0, 1, 0), (None, 1, 1), (8000, 0, 0)]
    folder = write(
        spark, tmp_path_factory.mktemp("t"), documents=spark.createDataFrame(docs, SCHEMA), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    )
    return folder, {i: (q, t) for i, q, t in labels}, len(docs)


def held_out(rows, n, rest):
    return [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % n == rest]


def test_toxicity(spark, tables):
    folder, labels, n = tables
    rows = toxicity.op4_toxicity(spark, folder).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [r for r in held_out(rows, 5, 0) if r.doc_id in labels]
    assert all(r.held_out for r in test)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in test]) > 0.95


def test_automaton_finds_all_within_one_edit():
    terms = ["grumbler", "vilething", "bad"]
    found = toxicity.Automaton({t: 1.0 for t in terms})
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "x", "e"])
        w = "".join(w)
        want = min((distance(w, t), t) for t in terms if distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_LENGTH else 0)) if any(distance(w, t) <= (1 if len(t) >= toxicity.FUZZY_LENGTH else 0) for t in terms) else None
        got = found.best(w)
        assert (got is None) == (want is None) and (got is None or got[1] == want[0]), (w, got, want)


def test_quoted_terms_weigh_apart():
    texts = [f"a b c{i} grumbler d{i} e f" for i in range(30)] + [f"plain words only {i} g h" for i in range(30)]
    model = toxicity.ToxicityModel(texts, [1] * 30 + [0] * 30)
    own, quoted = model.features("you are a grumbler now"), model.features('they said "you grumbler" to us')
    assert own[0] > 0 and own[1] == 0 and quoted[0] == 0 and quoted[1] > 0


def test_quality(spark, tables):
    folder, labels, n = tables
    rows = quality.op9_quality(spark, folder).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in held_out(rows, 5, 0) if r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id][0] for r in test]) > 0.95


def test_index_vectors_depend_on_the_whole_term():
    for terms in (["constitution", "constitutive"], ["правда", "правило"]):
        assert len({quality._index_vector(t).tobytes() for t in terms}) == 2


def test_language(spark, tables):
    folder, _, n = tables
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = langid.op5_language(spark, folder).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9004].lang_pred in ("xx", "yy")
    test = [r for r in held_out(rows, 3, 1) if r.doc_id < 9000]
    assert all(r.held_out for r in test) and np.mean([r.lang_pred == langs[r.doc_id] for r in test]) > 0.98


def test_models_without_labels(spark):
    docs, labels = docs_of(spark, ["a", None]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["__toxicity"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True))).collect()] == [0.5, 0.5]
    assert quality.score_quality(docs, quality.fit_quality(docs, labels, F.lit(True))).count() == 2
    assert [r["__language"] for r in langid.detect_language(docs, langid.fit_language(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))).collect()] == ["und", "und"]


CLASHES = ["toxicity", "quality", "quality_score", "language", "language_score", "posterior", "tokens", "rate", "score", "rows", "size", "key", "node", "id", "fp", "n", "c", "cls", "size", "turn", "x", "label"]


def clashing(df):
    for name in dict.fromkeys(CLASHES):
        df = df.withColumn(name, F.lit(f"mine {name}"))
    return df


def test_columns_of_any_name_come_through(spark, tables):
    folder, _, _ = tables
    docs, labels = clashing(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/labels.parquet")
    for found in (
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True), rows=50)),
        quality.score_quality(docs, quality.fit_quality(docs, labels, F.lit(True), rows=50)),
        langid.detect_language(docs, langid.fit_language(docs, F.lit(True), rows=50)),
        mixing.mix(docs, mixing.fit_domains(docs, labels, F.lit(True), rows=50), mixing.TARGETS).rows,
    ):
        assert found.columns[: len(docs.columns)] == docs.columns and all(c.startswith("__") for c in found.columns[len(docs.columns) :])
        assert found.select(*docs.columns).exceptAll(docs).count() == 0 and found.count() == docs.count()
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs.withColumn("__toxicity", F.lit(1)), toxicity.ToxicityModel(["x"], [1]))


def test_samples_are_bounded(spark):
    from sparkloom.llm import learning

    docs = spark.createDataFrame([(i % 7, f"text {i}", "xx" if i % 50 else "rare") for i in range(3000)] + [(None, f"t {i % 9}", "xx") for i in range(900)] + [(None, None, "xx"), (3000, "L" * 5000, "yy")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i % 7, i % 2, 0) for i in range(100)] + [(None, 1, 1), (3000, 1, 0), (5000, None, 1)], "doc_id bigint, quality int, toxic int")
    found = learning.labelled_sample(docs, labels, ["quality", "toxic"], F.lit(True), rows=20)
    # One text, the smallest, and the largest labels of each id that has both.
    assert sorted(found)[:2] == [("L" * 5000, 1, 0), ("text 0", 1, 0)] and len(found) == 8
    assert len(learning.labelled_sample(docs, labels, ["quality"], F.lit(True), rows=3)) == 3
    # A text too long for the sum of characters is passed over, others are not.
    assert len(learning.labelled_sample(docs, labels, ["quality"], F.lit(True), chars=200)) == 7
    own = learning.own_label_sample(docs, "lang", F.lit(True), rows=100)
    counts = Counter(x for _, x in own)
    assert len(own) == 100 and counts["yy"] == 1 and counts["rare"] >= 49 and len(set(own)) == 100
    assert learning.own_label_sample(docs.limit(0), "lang", F.lit(True)) == [] and learning.labelled_sample(docs.limit(0), labels, ["toxic"], F.lit(True)) == []


def test_empty_tables_give_nothing(spark, tmp_path):
    folder = write(spark, tmp_path, documents=docs_of(spark, []), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    for query in (toxicity.op4_toxicity, langid.op5_language, mixing.op6_mixing, audio.op7_chroma, quality.op9_quality, licenses.op10_licenses):
        assert query(spark, folder).count() == 0


def test_mixing_meets_its_targets(spark, tables):
    folder, _, n = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = mixing.fit_domains(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    targets = {"good": 0.5, "poor": 0.3, "good_toxic": 0.15, "poor_toxic": 0.05}
    mixed = mixing.mix(docs, model, targets, keep=["doc_id"])
    assert mixed.rows.count() == n and np.abs(np.array(mixed.after) - list(targets.values())).max() < 0.001
    assert mixed.rows.where("__rate < 0 or __rate > 4 or __rate is null").count() == 0
    # The shares reported are those that the rows' own rates, posteriors and tokens give.
    rows = mixed.rows.collect()
    sums = sum(np.array(r["__posterior"]) * r["__rate"] * r["__tokens"] for r in rows) / sum(r["__tokens"] for r in rows)
    assert np.abs(sums - mixed.after).max() < 1e-6
    out = mixing.op6_mixing(spark, folder).collect()
    assert len(out) == n and all(abs(r.share_reached - r.share_wished) < 0.01 for r in out)


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(1)
    p, t = rng.dirichlet([1, 1, 1], 60), rng.integers(1, 50, 60)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(p, t)], "__posterior array<double>, __tokens bigint")
    fitted, _, _, _ = mixing.fit_rates(rows, [0.6, 0.3, 0.1], ridge=0.05, rounds=300, enough=0)
    got = {tuple(r["__posterior"]): r["__rate"] for r in fitted.collect()}
    m, x = t / t.sum(), np.ones(60)
    for _ in range(20_000):
        x = np.clip(x - 0.5 * (p @ (p.T @ (m * x) - [0.6, 0.3, 0.1]) + 0.05 * (x - 1)), 0, 4)
    assert np.abs(np.array([got[tuple(map(float, a))] for a in p]) - x).max() < 1e-3


def test_empty_mixing(spark):
    rows = spark.createDataFrame([], "__posterior array<double>, __tokens bigint")
    fitted, past, before, after = mixing.fit_rates(rows, [0.5, 0.5])
    assert fitted.count() == 0 and past == [] and before == after == [0.0, 0.0]


def test_licences(spark):
    rng = random.Random(6)
    filler = " ".join(words(rng, "xx", 40))
    notices = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    texts = [f"{filler}\n{t}\n{filler}" for t in notices.values()] + [None, "", filler, "A license plate and a public road, version 3.", LONG + "\nReleased under the MIT License."]
    found = {r.doc_id: r["__licences"] for r in licenses.find_licences(docs_of(spark, texts).withColumn("x", F.lit(1)), licenses.LicenceModel()).collect()}
    for i, family in enumerate(notices):
        assert [(x.family, x.paragraph, x.confirmed) for x in found[i]] == [(family, 2, True)]
    assert [found[i] for i in (4, 5, 6, 7)] == [[], [], [], []] and [(x.family, x.paragraph) for x in found[8]] == [("mit", 2)]


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction""",
    "bsd": """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the
following conditions are met:""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or
modify it under the terms of the GNU General Public License,
either version 3 of the License, or (at your option)
any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this
software for any purpose with or without fee is hereby
granted, provided that""",
    "apache-2.0": """Licensed under the Apache License,
Version 2.0 (the "License"); you may not use
this file except in compliance with
the License.""",
}


def test_wrapped_licences(spark):
    rng = random.Random(8)
    lines = lambda n: "\n".join(" ".join(words(rng, "xx", 9)) for _ in range(n))
    texts = [f"{lines(k)}\n\n{t}\n\n{lines(5)}" for k, t in enumerate(WRAPPED.values())] + [f"{t}\n{lines(3)}" for t in WRAPPED.values()] + [lines(60)]
    df = docs_of(spark, texts).withColumn("licences", F.lit("mine"))
    found = {r.doc_id: r for r in licenses.find_licences(df, licenses.LicenceModel()).collect()}
    for i in range(10):
        assert {x.family for x in found[i]["__licences"] if x.confirmed} == {list(WRAPPED)[i % 5]} and found[i].licences == "mine"
    assert found[10]["__licences"] == []


def test_licence_scores_equal_the_model(spark):
    model = licenses.LicenceModel()
    texts = ["This work is licensed under the GNU General Public License, version 2", "permission is granted to any person", "mit mit mit license", "the of and"]
    got = spark.createDataFrame([(texts,)], "ps array<string>").select(licenses._paragraph_scores(F.col("ps"), model).alias("s")).first().s
    for text, s in zip(texts, got):
        z = np.array(model.bias)
        for g in licenses.grams_of(licenses.words_of(text)):
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        p = licenses.softmax(z / model.temperature)
        assert abs(s.p - p.max()) < 1e-9 and s.family == model.classes[int(p.argmax())]


def wav(samples):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(audio.RATE)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def melody(rng, notes):
    t = np.arange(1600) / audio.RATE
    return np.concatenate([4000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) + 1000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(notes)])


def test_audio_alignment(spark):
    rng = np.random.default_rng(7)
    songs = [melody(rng, 12) for _ in range(4)]
    cut = songs[1][20 * audio.HOP :]
    rows = [(i, wav(s)) for i, s in enumerate(songs)] + [(10, wav(cut)), (11, wav(songs[2] + rng.normal(0, 2, len(songs[2])))), (12, wav(songs[0])), (13, None), (14, b""), (15, b"RIFFxxxxWAVEbroken"), (16, wav(np.zeros(8000)))]
    found = {r.id: r for r in audio.align_recordings(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()}
    assert len(found) == len(rows)
    assert [found[i].recording for i in (0, 1, 2, 3, 10, 11, 12)] == [0, 1, 2, 3, 1, 2, 0]
    assert abs(found[10].shift) == 20 and found[10].errors < 0.05
    assert [found[i].recording for i in (13, 14, 15)] == [13, 14, 15] and found[13].n_prints == 0


def best_errors(x, y):
    """Least share of differing bits over all offsets with enough overlap."""
    best = 1.0
    for shift in range(-len(y) + 1, len(x)):
        u, v = (x[shift:], y) if shift >= 0 else (x, y[-shift:])
        n = min(len(u), len(v))
        if n >= max(audio.LEAST_OVERLAP, audio.LEAST_SHARE * min(len(x), len(y))):
            best = min(best, float(np.bitwise_count(u[:n] ^ v[:n]).sum()) / (32 * n))
    return best


def test_audio_recall_against_all_pairs_at_all_offsets(spark):
    """Six melodies in 25 noisy cuts each, and one in 50: pairs by bit errors alone, without landmarks or votes."""
    rng = np.random.default_rng(9)
    rows = []
    for k, n in enumerate([25] * 6 + [50]):
        s = melody(rng, 6)
        for j in range(n):
            cut = s[(j % 6) * 3 * audio.HOP :]
            rows.append((100 * k + j, wav(cut + rng.normal(0, 1, len(cut)))))
    prints = {i: audio.packed_integers(audio.chroma(audio.decode(d))) for i, d in rows}
    pairs = [(a, b) for n, a in enumerate(prints) for b in list(prints)[:n] if best_errors(prints[a], prints[b]) <= audio.MOST_ERRORS]
    found = {r.id: r for r in audio.align_recordings(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()}
    assert len(pairs) > 2000 and np.mean([found[a].recording == found[b].recording for a, b in pairs]) >= 0.98
    # Different melodies stay apart.
    assert all(r.recording // 100 == i // 100 for i, r in found.items())
    for r in found.values():
        if r.partner is not None:
            x, y = (prints[r.id][r.shift :], prints[r.partner]) if r.shift >= 0 else (prints[r.id], prints[r.partner][-r.shift :])
            n = min(len(x), len(y))
            assert abs(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n) - r.errors) < 1e-9


def test_audio_recall_on_texts(spark, tmp_path):
    """Near copies among texts: the pairs within the bound at any offset, by brute force."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = words(rng, "xx", 600)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(copy))
                copy[k] = "".join(rng.sample(copy[k], len(copy[k])))
            texts.append(" ".join(copy))
    folder = write(spark, tmp_path, documents=docs_of(spark, texts))
    prints = [audio.packed_integers(audio.chroma(audio.decode(t.encode()))) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if best_errors(prints[a], prints[b]) <= audio.MOST_ERRORS]
    found = {r.doc_id: r.recording for r in audio.op7_chroma(spark, folder).collect()}
    assert len(pairs) > 50 and np.mean([found[a] == found[b] for a, b in pairs]) >= 0.9


def test_melodies_that_share_an_opening_stay_apart(spark):
    rng = np.random.default_rng(10)
    opening = melody(rng, 5)
    rows = [(i, wav(np.concatenate([opening, melody(rng, 7)]))) for i in range(60)]
    found = audio.align_recordings(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()
    assert sum(r.recording != r.id for r in found) <= 2


def test_audio_of_empty_tables_and_repeats(spark):
    rng = np.random.default_rng(4)
    song = wav(melody(rng, 4))
    schema = "id bigint, media binary, recording string, partner int"
    assert audio.align_recordings(spark.createDataFrame([], schema), "id", "media").count() == 0
    rows = [(5, song, "x", 1), (5, song, "x", 1), (None, song, None, None), (None, None, None, None)]
    found = audio.align_recordings(spark.createDataFrame(rows, schema), "id", "media").collect()
    assert sorted((r.id is None, r.n_prints > 0, r.recording) for r in found if r.n_prints) == [(False, True, 5), (False, True, 5), (True, True, 5)]
    assert [(r.id, r.recording) for r in found if not r.n_prints] == [(None, None)]


def test_cells_compare_all_members(spark):
    """Lists of many in small blocks: the same recordings as by all pairs, and no list is compared in part."""
    from sparkloom.llm import linking

    members = spark.range(40).selectExpr("1L AS key", "id AS node", "id AS root", "40 AS size")
    cells = linking.in_cells(members, 7).collect()
    pairs = [tuple(sorted((p.node, q.node))) for p in cells for q in cells if (p.c1, p.c2) == (q.c1, q.c2) and p.node < q.node and (p.blk != q.blk or p.c1 == p.c2)]
    assert sorted(pairs) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
