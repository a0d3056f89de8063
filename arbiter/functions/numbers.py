"""Numeric scalar functions as Spark columns."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED = 1_000_000


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def unit(x: Column) -> Column:
    """Clamped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scaled to the range; clamped if the range is a point."""
    return F.when(low == high, unit(x)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def fixed_point(score: Column) -> Column:
    """Millionths, halves to even."""
    return F.bround(score * FIXED, 0).cast("long")


def decay(age: Column, half_life: float) -> Column:
    """0.5 to the power of the age in half-lives; the future counts as the present."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), age) / F.lit(float(half_life)))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def robertson_idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def sublinear(tf: Column) -> Column:
    return 1 + F.ln(tf)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def weighted(parts: dict[str, float]) -> Column:
    """Columns times their weights, added from left to right."""
    return reduce(lambda s, x: s + x, [F.col(c) * F.lit(w) for c, w in parts.items()])


#: Whether the double nearest to k hundredths and a half, for k from 0 to 99, is rounded up to two digits: it is above that number, or is it and k is odd.
_HALF_UP = [(Fraction((2 * k + 1) / 200), k % 2) > (Fraction(2 * k + 1, 200), 0) for k in range(100)]


def two_digits(x: Column) -> Column:
    """A number of at most 1 in size as text with two decimals, rounded from its exact binary value."""
    a = F.abs(x)
    k = F.floor(a * 100).cast("int")
    half = (2 * k + 1) / F.lit(200.0)
    up = F.when(a > half, 1).when(a < half, 0).otherwise(F.element_at(F.array(*[F.lit(int(b)) for b in _HALF_UP]), F.least(k, F.lit(99)) + 1))
    cents = k + up
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
