"""Guarded column expressions; NULL means missing everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    """a / b, null unless both are finite, |b| > epsilon and the quotient is finite."""
    if not (epsilon > 0 and math.isfinite(epsilon)):
        raise ValueError("epsilon must be finite and positive")
    return finite(F.when(F.abs(finite(b)) > epsilon, finite(a) / finite(b)))


def normalized_difference(a: Column, b: Column) -> Column:
    return safe_divide(a - b, a + b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    q = clip(p, epsilon, 1 - epsilon)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40.0, 40.0)))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by |: the same on every cluster and in any SQL engine."""
    key = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bits(flags: Column) -> Column:
    """A string of 0 and 1 from an array of booleans (null counts as 0)."""
    return F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "")


def season(start_month: Column) -> Column:
    return F.when(start_month <= 3, "01-03").when(start_month <= 6, "04-06").otherwise("07-09")
