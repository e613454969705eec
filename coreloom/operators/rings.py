"""Rings and groups of group sampling, as computed columns and aggregates.

A point of cluster c with cost in ``[D * 2^l, D * 2^(l+1))``, D the cluster's average, is in
ring l for l in -R..R with R = floor(log10(beta)); below the rings it is a shortfall point
(so are all points of a cluster with D = 0), above an overshot point. The bounds are tested
by comparisons, not by a rounded logarithm."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.session import small

BETA, BANDS = 10000, 4


def ring_points(assigned: DataFrame, cost: str = "cost", beta: int = BETA) -> DataFrame:
    """assigned: id, cluster, cost -> also avg_cost, kind (ring, shortfall, overshot), ring."""
    r = int(math.floor(math.log10(beta)))
    stats = assigned.groupBy("cluster").agg(F.avg(cost).alias("avg_cost"))
    rows = assigned.join(small(stats), "cluster")  # a row a cluster
    c, avg = F.col(cost), F.col("avg_cost")
    ring = F.lit(None).cast("int")
    for level in range(r, -r - 1, -1):
        ring = F.when(c < avg * 2.0 ** (level + 1), F.lit(level)).otherwise(ring)
    low = (avg == 0) | (c < avg * 2.0**-r)
    kind = F.when(low, "shortfall").when(c >= avg * 2.0 ** (r + 1), "overshot").otherwise("ring")
    return rows.withColumn("kind", kind).withColumn("ring", F.when(F.col("kind") == "ring", ring))


def _band(own, total, k):
    return F.when(own >= total / k, 0).when(own >= total / k / 2, 1).when(own >= total / k / 4, 2).otherwise(3)


def groups(points: DataFrame, cost: str = "cost", pooled: bool = False) -> DataFrame:
    """kind, ring, cluster, n, group_cost, band: one group for each (ring, cluster) and each
    cluster's overshot points; ``pooled`` joins the clusters of a band (cluster null)."""
    k = points.select("cluster").distinct().count()
    rows = points.where("kind <> 'shortfall'").groupBy("kind", "ring", "cluster").agg(F.count("*").alias("n"), F.sum(cost).alias("group_cost"))
    whole = F.sum("group_cost").over(W.partitionBy("kind", "ring"))
    rows = rows.withColumn("band", _band(F.col("group_cost"), whole, F.lit(float(k))))
    if pooled:
        rows = rows.groupBy("kind", "ring", "band").agg(F.sum("n").alias("n"), F.sum("group_cost").alias("group_cost")).withColumn("cluster", F.lit(None).cast("long"))
    return rows


def sample_plan(points: DataFrame, size: int, cost: str = "cost", least: float = 1.0) -> DataFrame:
    """The groups with share (T * cost(G) / cost(A)) and action: snap, keep or sample; of
    sampled groups also the number of draws before rounding."""
    whole = points.agg(F.sum(cost).alias("whole"))
    rows = groups(points, cost).join(F.broadcast(whole))
    rows = rows.withColumn("share", F.lit(float(size)) * F.col("group_cost") / F.col("whole"))
    action = F.when(F.col("share") < least, "snap").when(F.col("share") >= F.col("n"), "keep").otherwise("sample")
    rows = rows.withColumn("action", action)
    every = W.partitionBy()  # a row a group
    kept = F.coalesce(F.sum(F.when(F.col("action") == "keep", F.col("n"))).over(every), F.lit(0))
    queued = F.sum(F.when(F.col("action") == "sample", F.col("group_cost"))).over(every)
    draws = F.when(F.col("action") == "sample", (F.lit(float(size)) - kept) * F.col("group_cost") / queued)
    return rows.withColumn("draws", draws).drop("whole")
