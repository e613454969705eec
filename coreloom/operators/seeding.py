"""k-means++ seeding, plain and weighted, and k-means|| for large k.

Each round of k-means++ is one map that lowers every point's distance to the nearest seed
and one aggregate that draws the next seed: the smallest of ``-ln(1 - U) / (w d2)`` is a
draw in proportion to ``w d2``, without prefix sums and under any partitioning. The points
with their running distance are written every ``CUT`` rounds, which cuts the lineage."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.operators.sparse import dense_ids
from coreloom.functions import rng
from coreloom.operators.assign import matrix, nearest, squared
from coreloom.operators.lloyd import step
from coreloom.session import stored

CUT = 8


def _weighted(points: DataFrame) -> DataFrame:
    w = F.col("w").cast("double") if "w" in points.columns else F.lit(1.0)
    return points.select("id", F.col("v").cast("array<double>").alias("v"), w.alias("w"))


def _as_centers(spark, seeds: list) -> DataFrame:
    return spark.createDataFrame([(int(r["id"]), [float(x) for x in r["v"]]) for r in seeds], "cid long, v array<double>")


def kmeanspp(points: DataFrame, k: int, seed, weighted: bool = False) -> DataFrame:
    """cid (the seed's id), v, round. The first seed is uniform; k is cut to the number of
    different points."""
    spark = points.sparkSession
    state = _weighted(points)
    w = F.col("w") if weighted else F.lit(1.0)
    first = state.withColumn("_p", rng.uniform(seed, F.lit(0), "id")).orderBy("_p", "id").limit(1).collect()
    seeds, fresh = list(first), list(first)
    while first and len(seeds) < k:
        near = nearest(state, _as_centers(spark, fresh))
        now = near.withColumn("mind", F.least("mind", "d2") if "mind" in state.columns else F.col("d2")).drop("cluster", "d2")
        if len(fresh) >= CUT:
            now = state = stored(now, "seeding")
            fresh.clear()
        mass = w * F.col("mind")
        best = now.withColumn("_p", rng.priority(rng.uniform(seed, F.lit(len(seeds)), "id"), mass)).where("_p is not null").orderBy("_p", "id").limit(1).collect()
        if not best:
            break
        seeds.append(best[0])
        fresh.append(best[0])
    rows = [(int(r["id"]), [float(x) for x in r["v"]], i) for i, r in enumerate(seeds)]
    return spark.createDataFrame(rows, "cid long, v array<double>, round int")


def uniform_seeds(points: DataFrame, k: int, seed) -> DataFrame:
    """k uniform draws with replacement; repeats collapse."""
    ranked = dense_ids(points.select(F.col("id").alias("own")), "own")  # own, id: the rank
    n = ranked.count()
    draws = points.sparkSession.range(k).select(F.floor(rng.uniform(seed, "id") * n).alias("rank")).distinct()
    chosen = ranked.join(draws, ranked["id"] == draws["rank"]).select("own")
    return points.join(chosen, points["id"] == chosen["own"]).select(points["id"].alias("cid"), "v")


def _arrays(found: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(sorted(found), np.int64)
    return ids, np.array([found[i]["v"] for i in ids], np.float64)


def _drawn(shared):
    """Rows whose draw u lies below their share of the cost; only these leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, rate = shared.value
        for b in batches:
            if b.num_rows:
                d = squared(matrix(b.column(1)), c)[1]
                taken = b.column(3).to_numpy() < rate * b.column(2).to_numpy() * d
                yield b.select([0, 1]).filter(pa.array(taken))

    return run


def kmeans_parallel(points: DataFrame, k: int, seed, rounds: int = 4, factor: float = 2.0) -> DataFrame:
    """k-means||: a few rounds of oversampling, then weighted k-means++ on the candidates.

    An approximation of k-means++ with two passes a round instead of k in all. The candidates,
    about rounds * factor * k, are the only rows that reach the driver."""
    spark = points.sparkSession
    own = _weighted(points)
    first = own.withColumn("_p", rng.uniform(seed, F.lit(0), "id")).orderBy("_p", "id").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "cid long, v array<double>, round int")
    found = {int(r["id"]): r for r in first}
    for r in range(rounds):
        ids, c = _arrays(found)
        _, cost, _ = step(own, ids, c)
        if not cost:
            break
        rows = own.withColumn("u", rng.uniform(seed, F.lit(r + 1), "id"))
        shared = spark.sparkContext.broadcast((c, factor * k / cost))
        for row in rows.select("id", "v", "w", "u").mapInArrow(_drawn(shared), "id long, v array<double>").collect():
            found[int(row["id"])] = row
    ids, c = _arrays(found)
    _, _, mass = step(own, ids, c)
    on = np.flatnonzero(mass > 0)
    picked = on[local_kmeanspp(c[on], mass[on], k, seed)]
    return spark.createDataFrame([(int(ids[i]), c[i].tolist(), n) for n, i in enumerate(picked)], "cid long, v array<double>, round int")


def local_kmeanspp(x: np.ndarray, w: np.ndarray, k: int, seed) -> list[int]:
    """Weighted k-means++ on a small set in memory."""
    draw = np.random.default_rng(zlib.crc32(str(seed).encode()))
    picked = [int(draw.integers(len(x)))]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and (near * w).sum() > 0:
        i = int(np.searchsorted(np.cumsum(near * w), draw.random() * (near * w).sum(), "right"))
        picked.append(min(i, len(x) - 1))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    return picked
