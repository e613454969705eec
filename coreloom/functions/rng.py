"""Deterministic draws: functions of a seed and a key, the same under any partitioning and in any engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed, *keys) -> Column:
    """Uniform in [0, 1): 52 bits of md5('seed:key:...')."""
    parts = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    for k in keys:
        parts.append((F.col(k) if isinstance(k, str) else k if isinstance(k, Column) else F.lit(k)).cast("string"))
    digest = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(2**52))


def uniform_sql(seed, *keys: str) -> str:
    """The same in DuckDB's SQL; keys are SQL expressions."""
    text = " || ':' || ".join([f"'{seed}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def normal(seed, *keys) -> Column:
    """Standard normal by Box-Muller."""
    u = F.greatest(uniform(f"{seed}a", *keys), F.lit(2.0**-53))
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * uniform(f"{seed}b", *keys))


def normal_sql(seed, *keys: str) -> str:
    u = f"greatest({uniform_sql(f'{seed}a', *keys)}, {2.0**-53!r}::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos({2.0 * math.pi!r}::DOUBLE * {uniform_sql(f'{seed}b', *keys)}))"


def stochastic_round(value, u) -> Column:
    """floor(v) or ceil(v) with mean v."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.floor(v) + F.when(u < v - F.floor(v), 1).otherwise(0)).cast("long")


def priority(u: Column, weight: Column) -> Column:
    """Smallest priority = one draw in proportion to the weight; the s smallest = s draws
    without replacement. Rows of weight 0 get null. One aggregate, no prefix sums."""
    return F.when(weight > 0, -F.ln(1.0 - u) / weight)
