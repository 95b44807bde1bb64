"""Line-first cleaning with DataFrame functions only.

Each line with a word is tested by three rules; failing lines are removed, and
a document that loses too much of its text is rejected:

- punctuation: symbols and punctuation marks make up too large a share of the
  line's characters, or a fragment of a few words carries no sentence end;
- navigation: separators between words, or a menu or paging phrase alone;
- boilerplate: a legal, cookie, script or sign-up phrase in a short line.

Besides, base figures of the whole text are counted, among them words in
repeated three-word windows. All of it happens inside the row: no shuffle.

Null texts count as empty; documents without words fail. Lines without a word
are neither judged nor counted and do not reach the cleaned text. Repeated
rows and ids are judged on their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import col, table, without

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!-/:-@\[-`{-~]"          # ASCII punctuation
SENTENCE_END = r"[.!?:;。！？…؟।][\"'”’»)\]]*[\x20\x09-\x0D]*$"
MARK_SHARE = 0.2       # of a line's characters that are not white space
FRAGMENT = 3           # words; shorter lines need a sentence end
SEPARATORS = r"(^|[\x20\x09])(\||»|›|•|·|→|>|/|::)(?=[\x20\x09]|$)"
SEPARATOR_SHARE = 0.2  # separators per word
NAVIGATION = (r"(?i)^[\x20\x09]*(home|menu|next|previous|prev|back|back to top|read more|more|skip to (main )?content|"
              r"click here|login|log in|sign in|sign up|register|search|share|print|contact us|about us|sitemap|faq|"
              r"page [0-9]+( of [0-9]+)?|[0-9]+ comments?)[\x20\x09.:>»]*$")
BOILERPLATE = (r"(?i)(all rights reserved|terms (of (use|service)|and conditions)|privacy policy|cookie policy|"
               r"(use|uses|accept) (of )?cookies|enable javascript|javascript (is|must be)|lorem ipsum|"
               r"subscribe to (our|the)|newsletter|powered by|copyright (©|\(c\)))")
BOILERPLATE_WORDS = 30  # longer lines are prose that mentions a phrase
LOST_SHARE = 0.5
MIN_WORDS = 50


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted as one long each: high bits of a hash, low bits the
    place. Neighbours with the same high bits are compared word by word; where
    different windows share them, the windows themselves are sorted instead.
    """
    def same_words(w, p, q):
        return (w[p] == w[q]) & (w[p + 1] == w[q + 1]) & (w[p + 2] == w[q + 2])

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def by_hash(w, mask):
        group = lambda x: x.bitwiseAND(F.bitwise_not(mask))
        place = lambda x: x.bitwiseAND(mask).cast("int")
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: group(
            F.xxhash64(w[i], w[i + 1], w[i + 2])).bitwiseOR(i.cast("long")))

        def neighbours(s):
            alike = lambda x, k: F.coalesce(group(F.get(s, k)) == group(x), F.lit(False))
            return F.filter(s, lambda x, k: alike(x, k - 1) | alike(x, k + 1))

        def counted(c):
            mixed = F.exists(F.sequence(F.lit(1), F.size(c) - 1), lambda k: (group(c[k - 1]) == group(c[k]))
                             & ~same_words(w, place(c[k - 1]), place(c[k])))
            return F.when(F.size(c) < 2, 0).when(mixed, by_words(w)).otherwise(covered(F.transform(c, place)))

        return let(let(F.sort_array(packed), neighbours), counted)

    def by_words(w):
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i")))

        def repeated(s):
            same = lambda x, k: F.coalesce((F.get(s, k)["a"] == x["a"]) & (F.get(s, k)["b"] == x["b"])
                                           & (F.get(s, k)["c"] == x["c"]), F.lit(False))
            return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

        return covered(F.transform(let(F.sort_array(rows), repeated), lambda x: x["i"]))

    # the bits that hold a place in an array of this size
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words).cast("long")))) - 1
    return F.when(F.size(words) < 4, 0).otherwise(let(words, lambda w: let(mask, lambda m: by_hash(w, m)))).cast("long")


def failed_rule(line: Column) -> Column:
    """Name of the first rule that a line fails, or ''."""
    solid = F.length(F.regexp_replace(line, SPACES, ""))
    n_words = F.regexp_count(line, F.lit(WORD))
    return (F.when((F.regexp_count(line, F.lit(MARKS)) > solid * MARK_SHARE) & (n_words > 1)
                   | (n_words < FRAGMENT) & ~line.rlike(SENTENCE_END), "punctuation")
            .when((F.regexp_count(line, F.lit(SEPARATORS)) > n_words * SEPARATOR_SHARE) | line.rlike(NAVIGATION),
                  "navigation")
            .when((n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE), "boilerplate").otherwise(""))


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its base figures, the cleaned text, lines removed by
    each rule, the share of text lost and the verdict ``kept``."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text",
            "n_punctuation", "n_navigation", "n_boilerplate", "lost_share", "kept"]
    whole = F.coalesce(col(text), F.lit(""))
    # keeps the input's text, replaced or not, and the two arrays, under names of their own
    out = df.select(*map(col, without(df, made)), whole.alias("__text"), split_words(whole).alias("__words"),
                    F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"))
    out = out.withColumn("__judged", F.transform("__lines", lambda x: F.struct(x.alias("line"), failed_rule(x).alias("rule"))))

    def n_failing(rule: str) -> Column:
        return F.size(F.filter("__judged", lambda x: x["rule"] == rule)).cast("long")

    kept_lines = F.transform(F.filter("__judged", lambda x: x["rule"] == ""), lambda x: x["line"])
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
        "clean_text": F.array_join(kept_lines, "\n"),
        **{f"n_{rule}": n_failing(rule) for rule in ("punctuation", "navigation", "boilerplate")}})
    left = F.length(F.regexp_replace("clean_text", SPACES, ""))
    out = out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "lost_share": F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(F.lit(0.0))})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= LOST_SHARE))
    return out.drop("__text", "__words", "__lines", "__judged")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
ls AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT doc_id, l, length(regexp_replace(l, '{SPACES}', '', 'g')) AS solid,
    len(regexp_extract_all(l, '{WORD}')) AS n, len(regexp_extract_all(l, '{MARKS}')) AS marks,
    len(regexp_extract_all(' ' || replace(l, ' ', '  ') || ' ', '[\x20\x09](\||»|›|•|·|→|>|/|::)[\x20\x09]')) AS seps
  FROM ls),
verdict AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines,
    sum(CASE WHEN (marks > solid * {MARK_SHARE} AND n > 1)
        OR (n < {FRAGMENT} AND NOT regexp_matches(l, '{SENTENCE_END.replace("'", "''")}'))
        OR seps > n * {SEPARATOR_SHARE} OR regexp_matches(l, '{NAVIGATION}')
        OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(l, '{BOILERPLATE}')) THEN 0 ELSE solid END) AS solid_left
  FROM judged GROUP BY doc_id),
ws AS (
  SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols FROM d),
wins AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM ws)),
reps AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1)
  GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(solid_left, 0) AS solid_left
  FROM ws LEFT JOIN verdict USING (doc_id) LEFT JOIN reps USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
    AND 1 - solid_left::DOUBLE / greatest(word_chars, 1) <= {LOST_SHARE} AS kept
FROM base"""
