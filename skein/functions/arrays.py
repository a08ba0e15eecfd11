"""Array column helpers: fit, mask, argmax, log-sum-exp, pick.

All are built-in higher-order expressions, so they stay inside whole-stage
codegen and never cross into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_LABEL = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fit_length(ids, n: int, pad: int = 0) -> Column:
    """Truncate to ``n`` and right-pad with ``pad`` to exactly ``n``."""
    ids = _c(ids)
    short = F.greatest(F.lit(0), F.lit(n) - F.size(ids))
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), short))


def attention_mask(n_tok, n: int) -> Column:
    """1 for each real token, 0 for padding; ``n_tok`` already truncated to n (T4)."""
    k = F.least(_c(n_tok), F.lit(n))
    ones = F.array_repeat(F.lit(1).cast("tinyint"), k)
    zeros = F.array_repeat(F.lit(0).cast("tinyint"), F.lit(n) - k)
    return F.concat(ones, zeros)


def mask_pad(ids, pad: int = 0, ignore: int = IGNORE_LABEL) -> Column:
    """labels = ids with every pad id replaced by the ignore label (B1).

    With pad == eos a genuine end-of-text token is masked as well; that is the
    reference behaviour and the default.
    """
    return F.transform(_c(ids), lambda x: F.when(x == F.lit(pad), F.lit(ignore)).otherwise(x))


def mask_by_position(ids, mask, ignore: int = IGNORE_LABEL) -> Column:
    """labels masked where attention_mask is 0 (keeps genuine EOS)."""
    return F.zip_with(_c(ids), _c(mask), lambda x, m: F.when(m == 0, F.lit(ignore)).otherwise(x))


def argmax(arr) -> Column:
    """0-based index of the first maximum (lowest index wins ties)."""
    arr = _c(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def logsumexp(arr) -> Column:
    arr = _c(arr)
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def stablemax_s(x: Column) -> Column:
    """s(x) = 1/(1-x+1e-30) for x<0 else x+1."""
    return F.when(x < 0, F.lit(1.0) / (F.lit(1.0) - x + F.lit(1e-30))).otherwise(x + F.lit(1.0))


def pick(arr, idx) -> Column:
    """arr[idx] with a 0-based index; NULL when out of range (ANSI safe)."""
    return F.get(_c(arr), _c(idx))

