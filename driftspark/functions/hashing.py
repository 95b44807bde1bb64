"""Reproducible pseudo-random columns.

Every random choice in this package (shuffle order, samples, splits,
permutations) comes from a hash of the row's own key and a seed, so a result
does not depend on how the rows are partitioned, survives the loss and
recomputation of a partition unchanged, and can be repeated in plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits of an md5: exact both as BIGINT and as DOUBLE.
HASH_BITS = 52
# Largest prime below 2^40, so a * (perm + 1) + b stays inside a BIGINT.
PERM_BITS = 40
PERM_PRIME = 2**40 - 87


def _digest(key: Sequence[str], seed: int) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def hash_key(key: Sequence[str], seed: int) -> Column:
    """Uniform integer in [0, 2^52) from the row key and the seed."""
    return _hex(_digest(key, seed), 1, 13)


def hash_unit(key: Sequence[str], seed: int) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(key, seed) / F.lit(float(2**HASH_BITS))


def perm_parts(key: Sequence[str], seed: int) -> tuple[Column, Column]:
    """Two independent 40-bit numbers per row; see :func:`perm_hash`."""
    digest = _digest(key, seed)
    return _hex(digest, 1, 10), _hex(digest, 11, 10)


def perm_hash(a: Column, b: Column, perm: Column) -> Column:
    """Order key of a row in permutation ``perm``: (a * (perm + 1) + b) mod p.

    A line over a prime field, evaluated at a different point for each
    permutation: rows are independent of each other inside a permutation and
    the keys of one row are pairwise independent across permutations. One
    digest per row therefore serves any number of permutations.
    """
    return F.pmod(a * (perm + F.lit(1)) + b, F.lit(PERM_PRIME))
