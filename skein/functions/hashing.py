"""Deterministic pseudo-randomness from md5 of (seed, key).

``rand()`` changes when a task is retried or the partitioning changes; a hash
of the row's own key does not, so every draw here survives executor loss and
is reproducible on another engine (the same md5 prefix is used by the SQL
oracles).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _key(seed, cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.concat_ws(":", *parts)


def hash_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1) from md5('seed:k1:k2...')."""
    h = F.substring(F.md5(_key(seed, cols)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(_TWO_32)


def hash_long(seed, *cols) -> Column:
    """Non-negative 60-bit integer from md5('seed:k1:k2...'); used as a sort key."""
    h = F.substring(F.md5(_key(seed, cols)), 1, 15)
    return F.conv(h, 16, 10).cast("bigint")


def hash_int(seed, lo: int, hi: int, *cols) -> Column:
    """Uniform integer in [lo, hi] (inclusive)."""
    return (F.lit(lo) + F.floor(hash_uniform(seed, *cols) * F.lit(hi - lo + 1))).cast("int")


def hash_normal(seed, *cols) -> Column:
    """Standard normal via Box-Muller on two independent hash uniforms."""
    u1 = hash_uniform(seed, F.lit("a"), *cols)
    u2 = hash_uniform(seed, F.lit("b"), *cols)
    return F.sqrt(-2.0 * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)
