"""Classifiers and the pipeline: held-out accuracy, odd rows, plain code."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import ROWS, clashing, documents
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import corpus_pipeline
from driftspark.llm import attention, licences
from driftspark.llm.registry import QUERIES

WHOLE = "/root/testdata/sf0.01"


def test_attention_gradient():
    """The fit follows the slope of its own loss: it separates two kinds."""
    good = [f"the old mill of the town {i} stood by the river and the people liked it." for i in range(60)]
    bad = [f"BUY!! NOW!! {i} $$$ ### |||" for i in range(60)]
    model = attention.fit(good + [g + "\n" + b for g, b in zip(good, bad)], [1] * 60 + [0] * 60)
    s = np.array(model.scores(good + [g + "\n" + b for g, b in zip(good, bad)]))
    assert s[:60].min() > 0.7 > 0.3 > s[60:].max()


def test_attention_long_text_in_pieces(monkeypatch):
    model = attention.fit(["a b c d", "X!! Y!!"] * 8, [1, 0] * 8)
    text = "some words here and there\n" * 3000
    whole = model.scores([text, "", None, "a"])
    monkeypatch.setattr(attention, "PIECE", 26 * 100)  # whole lines
    assert model.scores([text, "", None, "a"]) == pytest.approx(whole, abs=5e-3)  # a piece ends a line
    assert attention.fit([], []).scores(["a", None]) == [0.5, 0.5]


def test_attention_rows(spark):
    labels = spark.createDataFrame([(r[0], i % 3 if i % 3 < 2 else None, 0) for i, r in enumerate(ROWS)], "doc_id long, quality int, toxic int")
    model = attention.train(documents(spark), labels)
    out = attention.score(clashing(documents(spark), ["score"]), model).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    none = attention.train(documents(spark, []), labels.limit(0))
    assert {r["score"] for r in attention.score(documents(spark), none).collect()} == {0.5}


def test_attention_held_out(spark):
    out = QUERIES["op6_attention"](spark, WHOLE).toPandas()
    labels = spark.read.parquet(f"{WHOLE}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.93
    assert both[both.quality == 1].predicted.mean() > 0.96


def test_licences(spark):
    texts = ["The mill is old.\nThis work is licensed under the GNU General Public License, version 3.\nThe end of it all is here.",
             "He got his driving licence in May and the public was free to see it.", "released under the mit license",
             "word " * 200 + "Licensed under the Apache License, Version 2.0. " + "and so it went " * 100, None, "", "a b c"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + ROWS
    docs = documents(spark, rows)
    model, floor = licences.train(docs)
    out = licences.scan(clashing(docs, ["family", "Line"]), model, floor).collect()
    assert {(r["doc_id"], r["line"], r["family"]) for r in out} == {(0, 1, "GPL"), (2, 0, "MIT"), (3, 0, "Apache-2.0")}
    assert "odd. name`s" in out[0].asDict()
    assert licences.scan(documents(spark, []), *licences.train(documents(spark, []))).count() == 0


MIT = """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
BSD = """ * Copyright (c) 2019, The Authors
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
"""
GPL = """The mill of the town
was old.

# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
BOTH = """Released under the MIT License.
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.
"""


def test_wrapped_licences(spark):
    """Notices over several lines, short lines that are a name; a statement of
    one line is no second row of the lines around it."""
    texts = [MIT, BSD, GPL, BOTH, "The mill is old.\nReleased under the MIT License.\nThe end of it all is here.", "the mit\nlicense", "Home\nGPL v3\nNews",
             "He has a free\nlicense to fish in\nthe public lake."]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + ROWS)
    out = licences.scan(docs, *licences.train(docs)).collect()
    assert Counter((r["doc_id"], r["line"], r["family"]) for r in out) == Counter(
        [(0, 0, "MIT"), (0, 4, "MIT"), (1, 2, "BSD"), (2, 3, "GPL"), (3, 0, "MIT"), (3, 0, "MIT"), (4, 1, "MIT"), (6, 1, "GPL")])


def test_licences_in_very_long_texts(spark):
    """Licence words all along one line, and along lines of one paragraph: the
    windows do not carry the text."""
    notice = "Licensed under the Apache License, Version 2.0"
    docs = documents(spark, [(1, "the license of plain words and mill town " * 25_000 + "\n\n" + notice, "en", "a", 1),
                             (2, "the license of plain words\n" * 40_000 + "\n" + notice, "en", "a", 1),
                             (3, (notice + " see the file. ") * 2_000, "en", "a", 1), *ROWS])
    out = licences.scan(docs, *licences.train(documents(spark))).collect()
    assert {(r["doc_id"], r["line"], r["family"]) for r in out} == {(1, 2, "Apache-2.0"), (2, 40_001, "Apache-2.0"), (3, 0, "Apache-2.0")}
    assert sorted(r["word"] for r in out if r["doc_id"] == 3) == list(range(0, 11 * 2_000 - 30, 30))


def test_licence_floor_of_all_documents(spark, monkeypatch):
    """Unknown lines near a statement stand in documents that the fit never
    reads (one too long, one without id, the rest beyond SAMPLE): the floor is
    that of all of them, as the model itself scores every line."""
    monkeypatch.setattr(licences, "SAMPLE", 5)
    near = ["released under the mit", "under the gnu general public", "this work is under creative attribution international"]
    chosen = {r[0] for r in spark.range(41).orderBy(F.xxhash64("id"), "id").limit(5).collect()}
    texts = [f"The old mill number {i} stood by the river.\n{'' if i in chosen else near[i % 2]}" for i in range(40)]
    texts.append(near[0] + "\n" + "plain words of a long text again\n" * 400)
    rows = [*((i, t, "en", "a", 1) for i, t in enumerate(texts)), (None, near[1], "en", "a", 1)]
    docs = documents(spark, rows)
    model, floor = licences.train(docs)
    windows = licences.unknown_windows(docs.select("text"), "text")
    p = model.transform(licences.vectors(windows)).select(F.array_max(F.slice(vector_to_array("probability"), 2, 99)).alias("p")).toPandas().p
    assert floor > licences.FLOOR and p.max() >= floor  # five documents, none of them kept out, gave FLOOR
    for least, share in ((0.5, 0.001), (0.2, 0.01), (0.01, 0.3), (0.0, 0.5), (1.0, 0.1)):
        monkeypatch.setattr(licences, "FLOOR", least)
        monkeypatch.setattr(licences, "FALSE_SHARE", share)
        assert licences.floor_of(windows, model) == pytest.approx(max(least, np.quantile(p, 1 - share)), abs=1e-9)


def test_windows_of_paragraphs(spark):
    """Against plain code: windows over several lines, with line and place of every word."""
    texts = ["a b\nc d e\n\nf g\nh", "one line only here", "", "\n\na\n\n", " ".join("abcdefgh" * 12) + "\n" + " ".join("xyz" * 20) + "\n\n\n"
             + "\n".join("pqrst" * 30), "a\nb"]

    def plain(text):
        spans, out = [[]], []
        for at, line in enumerate(text.split("\n")):
            ws = licences.plain_words(line)
            spans = spans if ws else [*spans, []]
            spans[-1] += [(at, k + 1, w) for k, w in enumerate(ws)]
        for s in spans:
            cuts = [s[k:k + licences.WINDOW] for k in range(0, max(len(s) - licences.WINDOW + licences.STEP, 1), licences.STEP)]
            out += [c for c in cuts if c and c[0][0] < c[-1][0]]
        return out if sum(map(len, spans)) >= licences.MIN_WORDS else []

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", licences.paragraph_windows(df.text).alias("w")).collect()
    assert {r["text"]: [[tuple(x) for x in w] for w in r["w"]] for r in got} == {t: plain(t) for t in texts}


def test_licence_windows_are_scored_once(spark):
    """The model scores in one place, after the filter on similarity and below
    no other one; the texts are read and searched for anchors once."""
    docs = documents(spark)
    model, floor = licences.train(docs)
    plan = licences.scan(docs, model, floor)._jdf.queryExecution().optimizedPlan().toString()
    # a line of the plan each: conditions that call the model, and generators that do
    lines = [re.sub(r"^[\s:+|-]*", "", x) for x in plan.split("\n")]
    assert not [x for x in lines if x.startswith(("Filter", "Join")) and "UDF(" in x]
    assert sum("UDF(" in x for x in lines if x.startswith("Generate")) == 1
    assert sum("monotonically_increasing_id" in x for x in lines) == 1


def test_grams(spark):
    """Against plain code; a pair begins at every word but the last, however long that is."""
    texts = ["a b c", "one", "a a a a", "größe 東京 x1 ÿ", "word " * 70 + "x" * 1_000_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licences.grams(F.col("t")).alias("g")).collect()
    for t, g in got:
        ws = t.split(" ")
        assert Counter(g) == Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])


def test_joint_windows(spark):
    """Those of paragraph_windows that hold an anchor, and no others."""
    texts = ["the mit\nlicense of a town", "plain words\nof a mill", "a licensed\n\nfree town\nof mill", " ".join(["mill"] * 70) + "\nlicense x\n"
             + "\n".join(["old town"] * 60), "one license of a line"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("every", licences.paragraph_windows(F.col("t"))).withColumn(
        "ws", licences.placed_words(F.col("t")))
    found, words = 0, set(licences.anchors())
    for r in df.withColumn("got", licences.joint_windows(F.col("ws"), licences.paragraph_heads(F.col("ws")))).collect():
        want = [(w[0]["at"], w[0]["place"], [x["w"] for x in w], [x["at"] for x in w], None) for w in r["every"] if words & {x["w"] for x in w}]
        assert [tuple(w) for w in r["got"]] == want
        found += len(want)
    assert found == 4


def test_anchors_lose_nothing():
    """Without them less than SIMILAR of any statement is left."""
    found = set(licences.anchors())
    for s in (s for many in licences.STATEMENTS.values() for s in many):
        ws = licences.plain_words(s)
        pairs = set(zip(ws, ws[1:]))
        assert sum(not found & set(p) for p in pairs) < licences.SIMILAR * len(pairs)
    assert all(found & set(licences.plain_words(s)) for many in licences.NAMES.values() for s in many)
    assert not found & {"the", "of", "and", "to", "in"}
    sizes = {len(set(zip(ws, ws[1:]))) for many in licences.STATEMENTS.values() for ws in map(licences.plain_words, many)}
    least = licences.least_pairs()
    assert all((least - 1) / n < licences.SIMILAR for n in sizes) and any(least / n >= licences.SIMILAR for n in sizes)


def test_licences_query(spark):
    docs = spark.read.parquet(f"{WHOLE}/documents.parquet").select("doc_id", "text").collect()
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    want = Counter((r["doc_id"], lines[x]) for r in docs for x in r["text"].split("\n") if x in lines)
    got = Counter((r["doc_id"], r["family"]) for r in QUERIES["op4_licences"](spark, WHOLE).collect())
    assert got == want


def test_pipeline(spark, sf):
    """Every stage on what the one before kept."""
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    kept[""] = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.write_table(stage(spark, docs, sf), "test-stage")
        kept[name] = docs.collect()
        if name != "sharded":
            assert docs.columns == before.columns
    from driftspark.llm import decontaminate, simhash
    model = attention.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {i: t for i, t in kept[""].items() if model.scores([t])[0] >= 0.7}
    assert {r["doc_id"] for r in kept["quality"]} == set(good)
    prints = {i: simhash.fingerprint(t) % (1 << 64) for i, t in good.items()}
    todo, least = sorted(good), set()
    while todo:
        group, new = set(), [todo[0]]
        while new:
            group |= set(new)
            new = [i for i in todo if i not in group and any((prints[i] ^ prints[j]).bit_count() <= 4 for j in new)]
        least.add(min(group))
        todo = [i for i in todo if i not in group]
    assert {r["doc_id"] for r in kept["near_duplicates"]} == least
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    scan = decontaminate.scan_part(bench)
    clean = set()
    for i in least:
        runs, _, counts, _ = scan([good[i]], [None], [None], [None], [None])
        hit = sum(b - a for a, b in runs[0])
        if not (hit and 20 * hit >= counts[0]):
            clean.add(i)
    assert {r["doc_id"] for r in kept["decontaminated"]} == clean
    times = Counter(r["doc_id"] for r in kept["mixed"])
    assert set(times) <= clean and max(times.values()) <= 2
    assert Counter(r["doc_id"] for r in kept["sharded"]) == times
    assert Counter(r["text"] for r in kept["mixed"]) == Counter({t: c for t, c in Counter(good[i] for i in times.elements()).items()})


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    """Stages bear nulls, repeated rows and empty tables."""
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = corpus_pipeline.write_table(stage(spark, docs, sf), "test-odd")
        assert docs.count() >= (5 if rows else 0)
    assert corpus_pipeline.quality(spark, documents(spark), sf).count() <= len(ROWS)
