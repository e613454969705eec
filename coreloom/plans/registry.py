"""Queries and their SQL, by name, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.operators import coresets, evaluate
from coreloom.plans import oracles, queries

QUERIES = queries.Q
ORACLES = oracles.S


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensitivity-sampled coreset of the vectors and its distortion for fixed centres."""
    p = queries.vectors(spark, sf_dir)
    coreset = coresets.sensitivity(p, 5, 200, seed=1)
    out = evaluate.distortions(p, coreset, [queries.fixed(p, 5 * i, 5 * i + 5) for i in range(3)])
    return out.select("solution", *[F.round(c, 6).alias(c) for c in ("real_cost", "coreset_cost", "distortion")])
