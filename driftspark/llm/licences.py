"""Licence scan by a trained paragraph classifier, with DataFrame and
``pyspark.ml`` operations only.

Windows of WINDOW words become word 1- and 2-grams, hashed to a sparse vector,
and a multinomial logistic regression tells licence families from the class
``unknown``. There are windows of single lines, and windows over the joined
words of adjacent lines, as notices are often wrapped; a line without words
ends a paragraph. The model is trained on the statements below in several
cuts, and for ``unknown`` on plain sentences about licences and on lines of at
most SAMPLE documents of the corpus. A family's probability must pass a floor,
calibrated on the unknown lines of all documents that the fit has not seen, and
the window must hold SIMILAR of the 2-grams of a statement of that family. A
line that is just the name of a licence is taken by its name.

The scan scores only windows that hold SIMILAR of any statement, which needs words
that most texts lack (:func:`anchors`); this leaves the result as it is. The
result has one row per confirmed window: line and word where it starts,
family, probability and similarity. A window of several lines is left out
where confirmed lines of its own family are all that confirms it; for that
confirmed rows, and no others, are shuffled. Null and empty texts have no
windows; repeated rows are scanned on their own; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.llm.common import col, drop_table, table, without, write_table

BINS = 1 << 13
WINDOW, STEP = 60, 30
MIN_WORDS = 4
SAMPLE = 400          # corpus documents in the fit
SAMPLE_BYTES = 8192   # longer ones are not taken for the fit, only for the floor
SIMILAR = 0.6
FLOOR, FALSE_SHARE = 0.5, 0.001  # least floor; share of kept-out unknown paragraphs above it
UNKNOWN = "unknown"

# Statements that licences ask to be printed, by family.
STATEMENTS = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction",
            "This project is licensed under the terms of the MIT license"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http www apache org licenses LICENSE 2.0", "Released under the Apache License 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation", "Released under the GNU GPL version 2 or later",
            "Licensed under the GPL v3"],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "Licensed under the GNU Lesser General Public License, version 2.1"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
             "Licensed under the GNU Affero General Public License, version 3"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", "Licensed under the BSD 3-Clause License", "Released under the BSD license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
                "Licensed under the Mozilla Public License, version 2.0"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0",
              "Content is available under CC BY 3.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                 "Licensed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal",
            "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted", "Licensed under the ISC License"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of "
                    "the publisher", "This document is confidential and proprietary. Unauthorized copying is prohibited"],
}
# Names that count where they are all the words of a line.
NAMES = {
    "MIT": ["MIT License", "The MIT License", "MIT Licence", "The MIT License MIT", "License MIT", "Expat License"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "License Apache 2.0",
                   "Apache License Version 2.0 January 2004"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL License", "GPL v2", "GPL v3", "GPLv2 License", "GPLv3 License", "License GPL",
            "License GPLv2", "License GPLv3", "License GPL v2", "License GPL v3", "License GPL 2.0", "License GPL 3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL License", "LGPL v2.1", "LGPL v3", "License LGPL", "License LGPL 2.1",
             "License LGPL 3.0"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPL License", "AGPL v3", "License AGPL", "License AGPL 3.0"],
    "BSD": ["BSD License", "The BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD 2-Clause", "BSD 3-Clause",
            "New BSD License", "Simplified BSD License", "License BSD", "License BSD 2-Clause", "License BSD 3-Clause"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "License MPL 2.0"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "License CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "License CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "License CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "License CC0 1.0"],
    "ISC": ["ISC License", "The ISC License", "License ISC"],
}
# Words too common to look for.
COMMON = frozenset("""the of to in and or is this a by for with it any as you under are that from not at be can may no all use has on if
its was work content text file""".split())
PLAIN = ["He passed the test and got his driving licence in May", "The licence fee was paid by the station every year",
         "The council granted a liquor license to the new bar", "A fishing license is required at the lake",
         "She works for a public company that makes software", "The general public was invited to the opening",
         "Permission to enter the building was granted by the guard", "The version of the story that he told was different",
         "Two people were permitted to copy the map of the valley", "The work was released in spring and sold well",
         "They use the file as a source for the new form", "This program starts at eight and is free of charge",
         "The foundation published a report about common land", "The terms of the contract were not clear to anyone"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(joined: Column) -> Column:
    """1- and 2-grams of words joined by a space. A pair is seen ahead of its
    first word, so that the next one starts at the second."""
    pairs = F.regexp_extract_all(joined, F.lit(r"\G(?=([^ ]+ [^ ]+))[^ ]+ "), F.lit(1))
    return F.concat(F.split(joined, " "), pairs)


def once(value: Column) -> Column:
    """A value made once per row, however often it is used, and after every
    filter before it: Spark moves no condition on it below a generator."""
    return F.explode(F.array(value))


def pair_hashes(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(words[i], words[i + 1])))


def least_pairs() -> int:
    """With fewer 2-grams no window holds SIMILAR of a statement."""
    sizes = {len(set(zip(ws, ws[1:]))) for many in STATEMENTS.values() for ws in map(plain_words, many)}
    return min(next(k for k in range(n + 1) if k / n >= SIMILAR) for n in sizes)


def rows_of(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small constant table."""
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in values))
    return spark.range(1).select(F.inline(cells))


def vectors(df: DataFrame) -> DataFrame:
    tf = HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BINS, binary=True)
    return tf.transform(df.withColumn("__grams", grams(F.col("__joined"))))


def families() -> list[str]:
    return [UNKNOWN, *STATEMENTS]


def statement_cuts() -> list[tuple[float, str]]:
    """(label, text): statements whole, without their ends, and repeated
    inside other words."""
    out = []
    for label, family in enumerate(families()):
        for s in STATEMENTS.get(family, PLAIN):
            ws = s.split()
            cuts = [s, s + " see the file for details", "copyright (c) 2020 by the authors " + s, "note " + s + " thank you"]
            if len(ws) > 8:
                cuts += [" ".join(ws[: len(ws) * 3 // 4]), " ".join(ws[len(ws) // 4:])]
            out += [(float(label), c) for c in cuts]
        out += [(float(label), s) for s in NAMES.get(family, ())]
    return out


def starts(words: Column) -> Column:
    """Where the windows of a line start; only a line of less than MIN_WORDS
    has a window of less."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - STEP), F.lit(1)), F.lit(STEP))


def paragraphs(df: DataFrame, text: str) -> DataFrame:
    """One row per window of a line, with __joined, its words joined by a space:
    a window is one value on its way, not an array of strings."""
    kept = [col(c) for c in df.columns if c.lower() != text.lower()]
    lines = df.select(*kept, F.explode(F.split(F.coalesce(col(text), F.lit("")), "\n")).alias("__line"))
    words = lines.select(*kept, once(words_of(F.col("__line"))).alias("__words")).where(F.size("__words") >= MIN_WORDS)
    return words.select(*kept, F.explode(F.transform(starts(F.col("__words")), lambda s: F.array_join(
        F.slice("__words", s, F.lit(WINDOW)), " "))).alias("__joined"))


def unknown_windows(df: DataFrame, text: str) -> DataFrame:
    """The windows of lines that say nothing of licences."""
    said = ["licens", "licenc", "copyright", "creative commons", "public domain", "redistribut", "all rights reserved"]
    return paragraphs(df, text).where(~reduce(Column.__or__, (F.col("__joined").contains(x) for x in said)))


def floor_of(windows: DataFrame, model: LogisticRegressionModel) -> float:
    """The percentile 1 - FALSE_SHARE of the windows' highest probabilities of
    a family, FLOOR at least. All windows are scored once; then the values above
    FLOOR are sorted, and of the others the greatest one is taken."""
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(STATEMENTS)))
    scored = write_table(model.transform(vectors(windows.select("__joined"))).select(best.alias("p")), "licence-floor")
    n, below = scored.agg(F.count("p"), F.coalesce(F.max(F.when(F.col("p") <= FLOOR, F.col("p"))), F.lit(0.0))).first()
    at = (n - 1) * (1 - FALSE_SHARE)
    over = max(n - 2 - int(at), 0)  # so many are greater than both values beside the percentile
    top = [r[0] for r in scored.where(F.col("p") > FLOOR).orderBy(F.desc("p")).offset(over).limit(2).collect()]
    drop_table(scored)
    if n < 2 or not top:
        return max(FLOOR, *top, 0.0)
    high, low = (*top, below)[:2]
    return max(FLOOR, low + (high - low) * (at - int(at)))


def train(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> tuple[LogisticRegressionModel, float]:
    """(model, floor). Two thirds of at most SAMPLE documents make the fit, all
    other documents, whole, the floor."""
    spark = docs.sparkSession
    chosen = write_table(docs.select(col(ident).alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE),
                         "licence-chosen")
    texts, out = docs.select(col(ident).alias("id"), col(text).alias("text")), F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    short = F.coalesce(F.octet_length("text") <= SAMPLE_BYTES, F.lit(False))
    unknown = write_table(unknown_windows(texts.where(short).join(F.broadcast(chosen), "id"), "text").select(
        F.lit(0.0).alias("label"), "__joined", out.alias("out")), "licence-sample")
    known = rows_of(spark, statement_cuts(), ["label", "text"]).select(
        "label", F.array_join(words_of(F.col("text")), " ").alias("__joined"))
    n_unknown = max(1, unknown.count())
    # a statement counts as much as all cuts of its size need to balance the corpus sample
    data = vectors(known.withColumn("w", F.lit(max(1.0, n_unknown / 300))).union(
        unknown.where("not out").select("label", "__joined", F.lit(1.0))))
    model = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="w", family="multinomial", regParam=2e-4,
                               maxIter=60, standardization=False, rawPredictionCol="", predictionCol="").fit(data)
    fitted = F.broadcast(chosen.distinct().where(~out).withColumn("fitted", F.lit(True)))
    rest = texts.join(fitted, "id", "left").where(F.col("fitted").isNull() | ~short).select("text")
    return model, floor_of(unknown_windows(rest, "text"), model)


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors() -> list[str]:
    """Words of which every window that holds SIMILAR of a statement, and every
    line that is a name, has at least one."""
    out: set[str] = set()
    for s in (s for many in STATEMENTS.values() for s in many):
        ws = plain_words(s)
        pairs = left = set(zip(ws, ws[1:]))
        while len(left) >= SIMILAR * len(pairs):
            rest = {w for p in left for w in p} - out
            known = [p for p in left if not out & set(p)]
            if len(known) < len(left):
                left = set(known)
                continue
            best = max(sorted(rest), key=lambda w: (w not in COMMON, sum(w in p for p in left)))
            out.add(best)
    for s in (s for many in NAMES.values() for s in many):
        ws = plain_words(s)
        if not out & set(ws):
            out.add(max(ws, key=lambda w: (w not in COMMON, not w.isdigit(), len(w))))
    return sorted(out)


def with_anchor(text: Column) -> Column:
    """Looked up where a word begins, and by first letters: most places are
    passed by at once."""
    heads: dict[str, list[str]] = {}
    for w in anchors():
        heads.setdefault(w[0], []).append(w[1:])
    words = "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items())
    return F.concat(F.lit(" "), F.lower(text)).rlike(
        r"[^a-z0-9\p{L}\p{N}](?=[" + "".join(heads) + r"])(?:" + words + r")(?![\p{L}\p{N}])")


def window(at: Column, start: Column, words: Column, lines: Column | None = None, title: Column | None = None) -> Column:
    return F.struct(at.alias("at"), start.alias("start"), words.alias("words"),
                    (F.lit(None).cast("array<int>") if lines is None else lines).alias("lines"),
                    (F.lit(None).cast("string") if title is None else title).alias("title"))


def line_windows(line: Column, at: Column) -> Column:
    """Windows of one line; the title is the whole line where it is short
    enough for a name."""
    longest = max(len(plain_words(t)) for many in NAMES.values() for t in many)

    def cut(ws):
        return F.transform(starts(ws), lambda s: window(
            at, s, F.slice(ws, s, F.lit(WINDOW)), title=F.when(F.size(ws) <= longest, F.array_join(ws, " "))))

    # an array of one element names the words, so that they are found once a line
    return F.flatten(F.transform(F.array(words_of(line)), cut))


def placed_words(text: Column) -> Column:
    """All words of a text with their line and place in it."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(words_of(x), lambda w, k: F.struct(
        i.alias("at"), (k + 1).alias("place"), w.alias("w")))))


def paragraph_heads(ws: Column) -> Column:
    """Where paragraphs begin in the words of a text, and its end; a line
    without words lies between two paragraphs."""
    every = F.when(F.size(ws) >= MIN_WORDS, F.sequence(F.lit(1), F.size(ws))).otherwise(F.array().cast("array<int>"))
    first = F.filter(every, lambda i: (i == 1) | (ws[i - 1]["at"] - ws[F.greatest(i - 2, F.lit(0))]["at"] > 1))
    return F.concat(first, F.array(F.size(ws) + 1))


def joint_spans(ws: Column, heads: Column) -> Column:
    """(start, n) of the windows over the joined words of adjacent lines.
    Windows of one line are left out."""
    spans = F.zip_with(F.slice(heads, 1, F.size(heads) - 1), F.slice(heads, 2, F.size(heads)), lambda a, b: F.transform(
        F.sequence(a, F.greatest(b - 1 - (WINDOW - STEP), a), F.lit(STEP)),
        lambda start: F.struct(start.alias("start"), F.least(F.lit(WINDOW), b - start).alias("n"))))
    return F.filter(F.flatten(spans), lambda x: ws[x["start"] + x["n"] - 2]["at"] > ws[x["start"] - 1]["at"])


def paragraph_windows(text: Column) -> Column:
    """The words, with line and place, of every window over adjacent lines."""
    def cut(ws):
        return F.flatten(F.transform(F.array(paragraph_heads(ws)), lambda heads: F.transform(
            joint_spans(ws, heads), lambda x: F.slice(ws, x["start"], x["n"]))))

    return F.flatten(F.transform(F.array(placed_words(text)), cut))


def joint_windows(ws: Column, heads: Column) -> Column:
    """The windows of :func:`paragraph_windows` that hold an anchor; no others
    are copied."""
    found = F.filter(joint_spans(ws, heads), lambda x: F.arrays_overlap(F.slice(ws, x["start"], x["n"])["w"], anchor_words()))
    return F.transform(found, lambda x: window(ws[x["start"] - 1]["at"], ws[x["start"] - 1]["place"], F.slice(ws, x["start"], x["n"])["w"],
                                               F.slice(ws, x["start"], x["n"])["at"]))


def anchor_words() -> Column:
    return F.array(*map(F.lit, anchors()))


def scan(docs: DataFrame, model: LogisticRegressionModel, floor: float, text: str = "text") -> DataFrame:
    """One row per confirmed window: the columns of ``docs`` but the text, and
    line, word (of the window in its line), family, probability, similarity."""
    made = ["line", "word", "family", "probability", "similarity"]
    kept = without(docs, [text, *made])
    names = families()
    statements = F.array(*(F.array(*(pair_hashes(words_of(F.lit(s))) for s in STATEMENTS[f])) for f in names[1:]))
    titles = F.create_map(*(F.lit(x) for k, f in enumerate(names) for t in dict.fromkeys(
        " ".join(plain_words(t)) for t in NAMES.get(f, ())) for x in (t, k)))
    # constants once per batch of rows, not per row
    fixed = F.broadcast(docs.sparkSession.range(1).select(
        statements.alias("__statements"), F.array_distinct(F.flatten(F.flatten(statements))).alias("__hashes"), titles.alias("__titles")))
    # transformers add their columns under these names; none may exist before
    base = docs.select(F.monotonically_increasing_id().alias("__id"), F.struct(*map(col, kept)).alias("__row"),
                       F.coalesce(col(text), F.lit("")).alias("__text")).where(with_anchor(F.col("__text")))
    # a text that has an anchor comes as part 0, for windows over adjacent lines, and line by line after that
    whole = F.col("__part") == 0
    parts = base.select("__id", "__row", F.posexplode(F.concat(F.array("__text"), F.split("__text", "\n"))).alias("__part", "__text"))
    parts = parts.where(whole | with_anchor(F.col("__text")))
    ws, heads = F.col("__all"), F.col("__heads")
    parts = parts.withColumn("__all", once(F.when(whole, placed_words(F.col("__text"))))).withColumn("__heads", once(paragraph_heads(ws)))
    # only windows leave this generator, never the words of a whole line or text
    rows = parts.select("__id", "__row", F.explode(F.when(whole, joint_windows(ws, heads)).otherwise(
        line_windows(F.col("__text"), F.col("__part") - 1))).alias("__w"))
    rows = rows.select("__id", "__row", *(F.col(f"__w.{c}").alias(f"__{c}") for c in ("at", "start", "words", "lines", "title"))).where(
        (F.size("__words") >= 2) & F.arrays_overlap("__words", anchor_words()))
    rows = rows.crossJoin(fixed).withColumn("__named", F.col("__titles")[F.col("__title")])
    # an array of one element names the pairs, so that they are hashed once a window and not once a statement
    held = lambda pairs: F.transform(F.array(pairs), lambda own: F.transform("__statements", lambda f: F.array_max(
        F.transform(f, lambda s: F.size(F.array_intersect(s, own)) / F.size(s)))))[0]
    # most windows have too few pairs of all statements together
    rows = rows.withColumn("__pairs", once(F.array_intersect("__hashes", pair_hashes(F.col("__words")))))
    rows = rows.where(F.col("__named").isNotNull() | (F.size("__words") >= MIN_WORDS) & (F.size("__pairs") >= least_pairs()))
    rows = rows.withColumn("__held", once(held(F.col("__pairs"))))
    rows = rows.where(F.col("__named").isNotNull() | (F.size("__words") >= MIN_WORDS) & (F.array_max("__held") >= SIMILAR))
    p = F.slice(vector_to_array("probability"), 2, len(STATEMENTS))
    # scored once, after that filter
    scored = model.transform(vectors(rows.withColumn("__joined", F.array_join("__words", " ")))).withColumn("__p", once(p))
    scored = scored.withColumn("__family", F.coalesce("__named", F.array_position("__p", F.array_max("__p")).cast("int")))
    of_family = lambda c: F.element_at(c, F.col("__family"))
    found = scored.withColumn("__best", of_family("__p")).withColumn(
        "__similar", F.when(F.col("__named").isNotNull(), F.lit(1.0)).otherwise(of_family("__held")))
    found = found.where(F.col("__named").isNotNull() | (F.col("__best") > floor) & (F.col("__similar") >= SIMILAR))
    # what a window of several lines holds besides the lines that are rows of this family themselves
    found = found.select("__id", "__row", "__at", "__start", "__words", "__lines", "__family", "__best", "__similar")
    near = Window.partitionBy("__id", "__family").orderBy("__at").rangeBetween(0, WINDOW)
    own = F.collect_set(F.when(F.col("__lines").isNull(), F.col("__at"))).over(near)
    found = found.withColumn("__own", own).crossJoin(fixed.select("__statements"))
    free = lambda i: ~F.array_contains("__own", F.col("__lines")[i])
    rest = F.transform(F.filter(F.sequence(F.lit(0), F.size("__words") - 2), lambda i: free(i) & free(i + 1)),
                       lambda i: F.xxhash64(F.col("__words")[i], F.col("__words")[i + 1]))
    found = found.where(F.col("__lines").isNull() | (F.size("__own") == 0) | (of_family(held(rest)) >= SIMILAR))
    label = F.element_at(F.array(*(F.lit(n) for n in names[1:])), F.col("__family"))
    return found.select(*(F.col("__row")[c].alias(c) for c in kept), F.col("__at").cast("long").alias("line"),
                        (F.col("__start") - 1).cast("long").alias("word"), label.alias("family"), F.round("__best", 4).alias("probability"),
                        F.round("__similar", 4).alias("similarity"))


def op4_licences(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, *train(docs))
