"""Worst-case instances with a known clustering, in closed form over ``spark.range``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows(spark: SparkSession, k: int, alpha: int, beta: float = 1.0) -> DataFrame:
    """id in [0, k^alpha), v of alpha * k: block b, column j is ([(id div k^b) mod k = j] - 1/k) * beta^-b."""
    def block(b: int) -> F.Column:
        digit = F.floor(F.col("id") / F.lit(k**b)) % k
        factor = float(beta) ** -b if beta > 1 else 1.0
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (F.when(digit == j, 1.0).otherwise(0.0) - 1.0 / k) * factor)

    parts = [block(b) for b in range(alpha)]
    return spark.range(k**alpha).select("id", F.concat(*parts).alias("v"))


def block_cluster(k: int, block) -> F.Column:
    """The cluster of a row by one block."""
    b = block if isinstance(block, F.Column) else F.lit(block)
    return (F.floor(F.col("id") / F.pow(F.lit(float(k)), b)) % k).cast("long")


def closed_cost(k: int, alpha: int, beta: float = 1.0) -> float:
    """Cost of clustering by block 0."""
    return k**alpha * (k - 1) / k * sum((beta ** (-2 * i) if beta > 1 else 1.0) for i in range(1, alpha))


def parse_name(path: str) -> tuple[int, int, float]:
    """(k, alpha, beta) from a file name such as benchmark-k10-alpha6-beta1.00."""
    found = re.search(r"k(\d+)-alpha(\d+)-beta(\d+(?:\.\d+)?)", path)
    if not found:
        raise ValueError(f"no parameters in {path!r}")
    return int(found[1]), int(found[2]), float(found[3])
