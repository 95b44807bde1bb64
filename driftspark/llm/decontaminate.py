"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words, runs of letters, digits and
non-ASCII characters. A window is WINDOW consecutive words of a benchmark item,
or the whole item where it has fewer. The automaton runs over word numbers, so
a text is scanned once, and matches map back to words and from these to the
characters of the original.

The automaton lives in every Python worker, so its size is bounded. A benchmark
whose texts and ids take at most ``max_bytes`` is one automaton and one scan of
the rows, without a shuffle. A larger one is never in one place: equal texts get
one number, long texts are cut into segments that share no window, segments are
dealt into parts of about ``max_bytes``, and each part is one more scan of the
numbered rows, whose hits are written before the next part is read. The hits of
a row are then brought together, and item ids come back by joins, once per set
of texts that some row holds, however many ids a text has.

Null or empty texts have no words and are never contaminated; an item without
words is never found. Rows of one item_id count as one item; an item whose id
is null is scanned for, but is not listed. An empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.llm.common import add_columns, col, drop_table, table, without, write_table
from driftspark.plans.workdir import new_path

WINDOW = 13
SHARE = 20  # contaminated from one hit word in SHARE words
PART_BYTES = 1 << 20  # of benchmark text in one automaton
SEGMENT = 4096  # words of an item in one piece
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def windows(seq: list) -> range:
    """Where the windows of an item of these words start."""
    return range(max(len(seq) - WINDOW, 0) + 1 if seq else 0)


def segments(text: str | None) -> list[str]:
    """The words of a text in pieces of at most SEGMENT words. Every window
    lies in exactly one piece."""
    seq = words(text)
    step = SEGMENT - WINDOW + 1
    return [b" ".join(seq[i:i + SEGMENT]).decode() for i in windows(seq)[::step]]


def build(items: list[tuple]):
    """(vocabulary, automaton, names) of (name, text) rows. A window maps to the
    numbers of the texts it occurs in, a number to the names of that text."""
    import ahocorasick

    ids: dict[bytes, int] = {}
    texts: dict[tuple, set] = {}
    for name, text in items:
        texts.setdefault(tuple(ids.setdefault(w, len(ids) + 1) for w in words(text)), set()).add(name)
    of: dict[tuple, list] = {}
    for number, seq in enumerate(texts):
        for window in {seq[i:i + WINDOW] for i in windows(seq)}:
            of.setdefault(window, []).append(number)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, numbers in of.items():
        machine.add_word(window, (len(window), tuple(numbers)))
    if of:
        machine.make_automaton()
    return ids, machine if of else None, list(texts.values())


def merged(runs: list) -> list[list[int]]:
    """Sorted runs [from, to) of words without overlap."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scanner(items: list[tuple]):
    """The function from a text to (number of words, merged runs, set of names
    of the items found). The automaton is built at the first call."""
    state: list = []

    def scan(text: str | None):
        if not state:
            state.append(build(items))
        ids, machine, names = state[0]
        ws = words(text)
        runs, found = [], set()
        if machine is not None and ws:
            for end, (n, numbers) in machine.iter(tuple(ids.get(w, 0) for w in ws)):
                runs.append((end + 1 - n, end + 1))
                found.add(numbers)
        return len(ws), merged(runs), set().union(*(names[k] for k in set().union(*found)))

    return scan


def scan_part(items: list[tuple]):
    """The function that finds the hits of these items and fills all columns."""
    scan = scanner(items)

    def run(texts, runs, names, counts, spans):
        for k, text in enumerate(texts):
            counts[k], runs[k], who = scan(text)
            names[k] = sorted(x for x in who if x is not None)
            spans[k] = char_spans(text, runs[k])
        return [runs, names, counts, spans]

    return run


def scan_hits(items: list[tuple]):
    """The function that finds runs and numbers of texts."""
    scan = scanner(items)

    def run(texts):
        found = [scan(t)[1:] for t in texts]
        return [[runs for runs, _ in found], [sorted(who) for _, who in found]]

    return run


def finish(texts, runs, names):
    """All columns, from the runs and names of all parts."""
    runs = [merged([tuple(r) for r in rs or ()]) for rs in runs]
    return [runs, [list(x or ()) for x in names], [len(words(t)) for t in texts], [char_spans(t, r) for t, r in zip(texts, runs)]]


def char_spans(text: str | None, runs) -> list[dict]:
    """Runs of words as (start, end) code points of the original text."""
    if not runs:
        return []
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, byte, point = [], 0, 0
    for edge in (e for a, b in runs for e in (at[a][0], at[b - 1][1])):  # rising
        point += len(raw[byte:edge].decode("utf-8", "replace"))
        byte = edge
        out.append(point)
    return [{"start": a, "end": b} for a, b in zip(out[::2], out[1::2])]


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RUNS = T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType())))
FIELDS = [RUNS, T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()),
          T.StructField("hit_spans", T.ArrayType(SPAN))]


def find_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", max_bytes: int = PART_BYTES) -> DataFrame:
    """Every row with n_words, n_hit, hit_runs (words), hit_spans (characters),
    items (ids as strings, sorted) and contaminated."""
    bench = benchmark.select(col(item).cast("string").alias("item"), col(item_text).alias("text")).where(
        F.col("text").isNotNull())
    size = bench.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    if size <= max_bytes:
        out = docs
        for f in FIELDS:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType)) if f.name != text else out
        rows = [(r.item, r.text) for r in bench.collect()]  # at most max_bytes
        out = add_columns(out, [text, *(f.name for f in FIELDS)], scan_part(rows), FIELDS)
    else:
        out = overlap_in_parts(docs, bench, text, max_bytes)
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return out.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def benchmark_parts(bench: DataFrame, max_bytes: int):
    """(path, number of parts, ids): segments (no, segment) written by ``part``,
    each about ``max_bytes``, and a table of (no, item)."""
    texts = write_table(bench.select("text").distinct().withColumn("no", F.monotonically_increasing_id()), "bench-texts")
    ids = write_table(bench.join(texts, "text").where("item IS NOT NULL").select("no", "item").distinct(), "bench-ids")
    cut = add_columns(texts, ["text"], lambda ts: [[segments(t) for t in ts]],
                      [T.StructField("cut", T.ArrayType(T.StringType()))]).select("no", F.explode("cut").alias("segment"))
    cut = write_table(cut, "bench-segments")
    size = cut.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    parts, path = max(-(-size // max_bytes), 1), new_path(bench.sparkSession, "bench-parts")
    (cut.withColumn("part", F.pmod(F.xxhash64("no", "segment"), F.lit(parts)).cast("int"))
     .repartition("part").write.partitionBy("part").parquet(path))
    drop_table(texts)
    drop_table(cut)
    return path, parts, ids


def overlap_in_parts(docs: DataFrame, bench: DataFrame, text: str, max_bytes: int) -> DataFrame:
    """:func:`find_overlap` with one part of the benchmark at a time."""
    spark = docs.sparkSession
    path, parts, ids = benchmark_parts(bench, max_bytes)
    kept = without(docs, [f.name for f in FIELDS])
    sent = [*kept, *([] if text in kept else [text])]
    words_of = f"c{sent.index(text)}"
    # the row number is fixed by the files
    numbered = write_table(docs.select(F.monotonically_increasing_id().alias("row"), *(
        col(c).alias(f"c{i}") for i, c in enumerate(sent))), "overlap-rows")
    hits = []
    for p in range(parts):
        rows = [(r.no, r.segment) for r in spark.read.schema("no long, segment string, part int").parquet(path)
                .where(F.col("part") == p).select("no", "segment").collect()]  # about max_bytes
        found = add_columns(numbered.select("row", words_of), [words_of], scan_hits(rows),
                            [RUNS, T.StructField("nos", T.ArrayType(T.LongType()))])
        hits.append(write_table(found.where(F.size("nos") > 0).select("row", "hit_runs", "nos"), "overlap-hits"))
    by_row = write_table(spark.read.schema(hits[0].schema).parquet(*(h.table_path for h in hits)).groupBy("row").agg(
        F.flatten(F.collect_list("hit_runs")).alias("hit_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("nos")))).alias("nos")), "overlap-found")
    for h in hits:
        drop_table(h)
    # rows that hold the same texts share one list of ids
    sets = write_table(by_row.select("nos").distinct().withColumn("set", F.monotonically_increasing_id()), "overlap-sets")
    names = (sets.select("set", F.explode("nos").alias("no")).join(ids, "no").groupBy("set")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = by_row.join(sets, "nos").join(names, "set", "left").select("row", "hit_runs", "items")
    out = add_columns(numbered.join(found, "row", "left"), [words_of, "hit_runs", "items"], finish, FIELDS)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(f.name for f in FIELDS))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i + 1:i + {WINDOW}], ' ') AS win
  FROM b, unnest(range(greatest(len(ws) - {WINDOW - 1}, 1))) AS u(i) WHERE len(ws) > 0),
runs AS (SELECT doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM wins), unnest(range(greatest(len(ws) - n + 1, 0))) AS u(i)),
found AS (SELECT doc_id, i, r.n, item_id FROM runs r JOIN wins w ON r.win = w.win AND r.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS u(w) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""
