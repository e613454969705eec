"""Lloyd iterations, plain and weighted, and best of several runs.

An iteration is one map over the points: each partition returns at most k rows of partial
sums, so the shuffle and the driver see k * partitions rows. Clusters that lose all points
keep their centre. Points are read anew (or from the caller's cache) in each iteration and
centres are driver state of k rows, so there is no lineage to cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.operators.assign import matrix, squared
from coreloom.session import stored

_SUMS = "run int, cluster long, n double, cost double, s array<double>"


def _partial(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [(ids, c, np.zeros(len(ids)), np.zeros(len(ids)), np.zeros_like(c)) for ids, c in shared.value]
        for b in batches:
            if not b.num_rows:
                continue
            x, w = matrix(b.column(0)), b.column(1).to_numpy()
            heavy = x * w[:, None]
            for ids, c, n, cost, sums in runs:
                place, d = squared(x, c)
                n += np.bincount(place, w, len(ids))
                cost += np.bincount(place, w * d, len(ids))
                order = np.argsort(place, kind="stable")
                edge = np.flatnonzero(np.diff(place[order], prepend=-1))
                sums[place[order][edge]] += np.add.reduceat(heavy[order], edge)
        for i, (ids, _, n, cost, sums) in enumerate(runs):
            on = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(on), i, np.int32)), "cluster": pa.array(ids[on]), "n": pa.array(n[on]), "cost": pa.array(cost[on]), "s": pa.array(list(sums[on]), pa.list_(pa.float64()))})

    return run


def steps(points: DataFrame, runs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """``step`` for several sets of centres in one pass over the points."""
    spark = points.sparkSession
    w = F.col("w").cast("double") if "w" in points.columns else F.lit(1.0)
    rows = points.select(F.col("v").cast("array<double>").alias("v"), w.alias("w"))
    parts = rows.mapInArrow(_partial(spark.sparkContext.broadcast(runs)), _SUMS)
    flat = parts.select("run", "cluster", "n", "cost", F.posexplode("s").alias("pos", "x"))
    table = flat.groupBy("run", "cluster", "pos").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("x").alias("x")).toArrow()
    which, cluster, pos, n, cost, x = (table[c].to_numpy() for c in ("run", "cluster", "pos", "n", "cost", "x"))
    out = []
    for i, (ids, centers) in enumerate(runs):
        own = which == i
        place = np.searchsorted(ids, cluster[own])
        new, weight = centers.copy(), np.zeros(len(ids))
        new[place, pos[own]] = x[own] / n[own]
        weight[place] = n[own]
        out.append((new, float(cost[own & (pos == 0)].sum()), weight))
    return out


def step(points: DataFrame, ids: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(new centres, cost under the old ones, weights)."""
    return steps(points, [(ids, centers)])[0]


def lloyd(points: DataFrame, centers: DataFrame, iterations: int = 300, tol: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """(centers cid, v; cost before each iteration and of the result). Stops when the
    Frobenius norm of the centres' shift is below ``tol``."""
    return lloyd_runs(points, [centers], iterations, tol)[0]


def lloyd_runs(points: DataFrame, starts: list[DataFrame], iterations: int = 300, tol: float = 1e-4) -> list[tuple[DataFrame, list[float]]]:
    """``lloyd`` from several starts: an iteration is one pass for all that still move."""
    runs, costs = [], [[] for _ in starts]
    for centers in starts:
        rows = centers.select("cid", F.col("v").cast("array<double>").alias("v")).orderBy("cid").collect()
        runs.append((np.array([r["cid"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)))
    moving = list(range(len(runs)))
    for _ in range(iterations):
        if not moving:
            break
        for i, (new, cost, _) in zip(list(moving), steps(points, [runs[i] for i in moving])):
            ids, c = runs[i]
            costs[i].append(cost)
            runs[i] = ids, new
            if float(np.sqrt(((new - c) ** 2).sum())) < tol:
                moving.remove(i)
    for own, (_, cost, _) in zip(costs, steps(points, runs)):
        own.append(cost)
    frame = points.sparkSession.createDataFrame
    return [(frame([(int(i), [float(x) for x in v]) for i, v in zip(ids, c)], "cid long, v array<double>"), own) for (ids, c), own in zip(runs, costs)]


def best_of(points: DataFrame, k: int, seeds, iterations: int = 300, tol: float = 1e-4) -> tuple[DataFrame, float]:
    """The cheapest of one run a seed."""
    from coreloom.operators.seeding import kmeanspp

    best = None
    for seed in seeds:
        centers, costs = lloyd(points, kmeanspp(points, k, seed, weighted="w" in points.columns), iterations, tol)
        if best is None or costs[-1] < best[1]:
            best = centers, costs[-1]
    return best


CURVE_KS = (10, 20, 30, 40, 50, 70, 100, 200)


def cost_curve(points: DataFrame, ks=CURVE_KS, seed: int = 1, iterations: int = 300) -> DataFrame:
    """k, cost: full-data k-means with k-means|| seeds, for a list of k, iterated together."""
    from coreloom.operators.seeding import kmeans_parallel

    parts = max(points.sparkSession.sparkContext.defaultParallelism, points.count() // 100_000)
    own = stored(points.repartition(parts), "curve")  # read in every iteration
    runs = lloyd_runs(own, [kmeans_parallel(own, k, seed) for k in ks], iterations)
    return points.sparkSession.createDataFrame([(int(k), costs[-1]) for k, (_, costs) in zip(ks, runs)], "k int, cost double")
