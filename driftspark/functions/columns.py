"""Column expressions for tidying and scoring. All built-in, all codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftspark.functions.hashing import HASH_BITS, hash_key


def label_from_text(label: Column, negative: str = "benign") -> Column:
    """0 when the text names the negative class (any case), else 1."""
    return F.when(F.lower(label) == negative.lower(), 0).otherwise(1).cast("int")


def subnet24(ip: Column) -> Column:
    """a.b.c.d as a*65536 + b*256 + c; null when one of a, b, c is no number."""
    parts = F.split(ip, r"\.")
    a, b, c = (F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2, 3))
    return a * 65536 + b * 256 + c


def random_int(key: Sequence[str], n: int, seed: int) -> Column:
    """Uniform integer 0..n-1, the same for a row wherever it is read."""
    return F.floor(hash_key(key, seed) / F.lit(float(2**HASH_BITS)) * n).cast("int")


def row_id() -> Column:
    """Surrogate row id. Depends on the partitioning: for joins inside one
    materialised frame only; everything else here uses the row's own key."""
    return F.monotonically_increasing_id()


def threshold(score: Column, at: float = 0.5) -> Column:
    return (score >= at).cast("double")


def below(value: Column, t: float) -> Column:
    """1 below ``t``, else 0."""
    return F.when(value < t, 1).otherwise(0)


def whole_of_fraction(value: Column, t: float) -> Column:
    """Whole part of the fraction of value/t, which is always 0."""
    q = value / t
    return (q - q.cast("long")).cast("int")


def weighted_probability(weight: float, vector: str = "probability") -> Column:
    """Probability of class 1 times the model's weight."""
    return vector_to_array(F.col(vector))[1] * F.lit(float(weight))


def score_vector(score: Column) -> Column:
    """[1 - p, p] as a vector, as the evaluators expect it."""
    return array_to_vector(F.array(1.0 - score, score.cast("double")))


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)])
