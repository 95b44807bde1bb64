"""Rows that every operator over documents must bear."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PROSE = " ".join(f"word{i} and thing{i * 7} of mid{i * 3} so far{i * 5} it went{i}." for i in range(60))
ROWS = [
    (1, "A short text.", "en", "a", 13), (2, None, "en", "b", None), (3, "", None, "a", 0), (None, "no id here, only words.", "en", None, 5),
    (4, PROSE, "en", "a", 1), (4, PROSE, "en", "a", 1), (5, PROSE, "fr", "b", 1), (6, "\n\n  \t \n", "en", "c", 3),
    (7, "Ünïcode ß 漢字 \U0001f600 text with odd spaces here.", "de", "a", 9), (8, "x" * 50_000, "en", "a", 50_000),
    (9, "same line\n" * 500, "en", "b", 1), (10, "a b c " * 20_000, "en", "a", 1), (None, None, None, None, None),
    (-3, "\x00 control \x0b and\x0cfeed\r\nend", "en", "", 2),
]


def documents(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clashing(df, names):
    """``df`` with columns of these names that the operator must replace, one
    in capitals, and one odd name that must stay."""
    from pyspark.sql import functions as F

    out = df
    for k, n in enumerate(names):
        out = out.withColumn(n.upper() if k % 2 else n, F.lit("old"))
    return out.withColumn("odd. name`s", F.lit(7))
