"""Column builders for vectors (array<double>): all JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, s) -> Column:
    return F.transform(_c(a), lambda x: x * s)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm2(a) -> Column:
    return total(F.transform(_c(a), lambda x: x * x))


def d2(a, b) -> Column:
    """Squared Euclidean distance by differences (never negative)."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(d2(a, b))


def l1(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def l1_squared(a, b) -> Column:
    return l1(a, b) * l1(a, b)


def lp(a, b, p: float) -> Column:
    return F.pow(total(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def lp_squared(a, b, p: float) -> Column:
    return F.pow(lp(a, b, p), F.lit(2.0))


def kl(a, b) -> Column:
    """Generalised Kullback-Leibler divergence; a coordinate <= 0 raises."""
    a, b = _c(a), _c(b)
    value = total(F.zip_with(a, b, lambda x, y: x * F.ln(x / y))) - total(a) + total(b)
    bad = F.exists(a, lambda x: x <= 0) | F.exists(b, lambda x: x <= 0)
    return F.when(bad, F.raise_error(F.lit("coordinates must be positive")).cast("double")).otherwise(value)


def stable_total(a) -> Column:
    """Sum from the smallest magnitude on."""
    return total(F.array_sort(_c(a), lambda x, y: F.signum(F.abs(x) - F.abs(y)).cast("int")))


def has_nan(a) -> Column:
    return F.exists(_c(a), lambda x: F.isnan(x))


def projection(v, origin, direction) -> Column:
    """Length of v along a ray from ``origin``; negative lengths lie behind it."""
    return dot(sub(v, origin), direction)


def ray_distance(v, origin, direction) -> Column:
    """Distance of v from the ray; a point behind the origin is measured to the origin."""
    p = F.greatest(projection(v, origin, direction), F.lit(0.0))
    return l2(v, F.zip_with(_c(origin), _c(direction), lambda o, x: o + x * p))


def cf_cost(n, ls, ss, c) -> Column:
    """Cost of a clustering feature at c: SS - 2 LS.c + n c.c"""
    return _c(ss) - 2.0 * dot(ls, c) + _c(n) * norm2(c)


def distortion(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.greatest(F.try_divide(a, b), F.try_divide(b, a))
