"""Aggregations over assigned points, all with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import vec


def cluster_stats(assigned: DataFrame, cost="d2") -> DataFrame:
    """cluster, n, cost, avg_cost"""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"), F.avg(cost).alias("avg_cost"))


def total_cost(assigned: DataFrame, cost="d2") -> DataFrame:
    return assigned.agg(F.sum(cost).alias("cost"))


def normalized_cost(assigned: DataFrame, cost="d2") -> DataFrame:
    """Share of each point in the total; the total is one row."""
    whole = assigned.agg(F.sum(cost).alias("whole"))
    return assigned.join(F.broadcast(whole)).select("id", (F.col(cost) / F.col("whole")).alias("share"))


def centroids_long(assigned: DataFrame, weight=None) -> DataFrame:
    """cluster, pos, val: weighted means by coordinate; clusters of weight 0 are left out."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = assigned.select("cluster", w.alias("w"), F.posexplode("v").alias("pos", "x"))
    sums = rows.groupBy("cluster", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("n")).where("n > 0")
    return sums.select("cluster", "pos", (F.col("s") / F.col("n")).alias("val"))


def centroids(assigned: DataFrame, weight=None) -> DataFrame:
    """cid, v"""
    rows = centroids_long(assigned, weight).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("x"))
    return rows.select(F.col("cluster").alias("cid"), F.col("x.val").alias("v"))


def features(assigned: DataFrame, weight=None) -> DataFrame:
    """Clustering features: cluster, n, ls, ss (mergeable: all sums)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = assigned.select("cluster", w.alias("w"), F.posexplode("v").alias("pos", "x"))
    sums = rows.groupBy("cluster", "pos").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("ls"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("ss"))
    out = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "ls"))).alias("l"), F.sum("ss").alias("ss"))
    return out.select("cluster", "n", F.col("l.ls").alias("ls"), "ss")


def merge_features(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Add (or, with sign -1, take away) the features of b, cluster by cluster."""
    rows = a.select("cluster", "n", "ls", "ss").unionByName(b.select("cluster", (F.col("n") * sign).alias("n"), vec.scale("ls", F.lit(float(sign))).alias("ls"), (F.col("ss") * sign).alias("ss")))
    flat = rows.select("cluster", "n", "ss", F.posexplode("ls").alias("pos", "x"))
    sums = flat.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("ss").alias("ss"), F.sum("x").alias("ls"))
    out = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "ls"))).alias("l"), F.max("ss").alias("ss"))
    return out.select("cluster", "n", F.col("l.ls").alias("ls"), "ss")


def gram(points: DataFrame) -> DataFrame:
    """i, j, val of X'X for i <= j. A map gives each partition's partial matrix: d * d rows
    a partition are shuffled, whatever the number of points."""
    import numpy as np
    import pyarrow as pa

    from coreloom.operators.assign import matrix

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "val": pa.array(total[i, j])})

    return points.select("v").mapInArrow(run, "i int, j int, val double").groupBy("i", "j").agg(F.sum("val").alias("val"))


def frobenius(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(vec.norm2("v")).alias("mass"))


def frobenius_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared norm of A - B, rows paired by id; where the widths differ, of norms' difference."""
    both = a.select("id", F.col("v").alias("x")).join(b.select("id", F.col("v").alias("y")), "id")
    same = F.size("x") == F.size("y")
    return both.agg(F.sum(F.when(same, vec.d2("x", "y")).otherwise(vec.norm2("x") - vec.norm2("y"))).alias("mass"))


def head_per_group(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group in the order of a sequence column."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def worst_row(rows: DataFrame, value: str, index: str) -> DataFrame:
    """The row with the largest value; of several the first."""
    return rows.orderBy(F.desc(value), index).limit(1)
