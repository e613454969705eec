"""Local search by single swaps. Every round scores all its swaps in one job: with the two
smallest distances of each point, the cost after closing centre c and opening candidate q
is a sum over points, so no swap needs a pass of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import rng, vec
from coreloom.operators import blocks
from coreloom.session import small, stored


def _sums(cids: list[int]):
    """opened, closed, cost: the part of a task's points in the cost of every swap."""
    closed = np.array(cids, np.int64)

    def told(opened: np.ndarray, cost: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(opened, len(closed))), pa.array(np.tile(closed, len(opened))), pa.array(cost.T.ravel())], names=["opened", "closed", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, cost = None, None
        for b in batches:
            for row in range(b.num_rows):
                q, ids = blocks.side(b, row, "q", "opened")
                x, own, d_own, d_next = blocks.side(b, row, "p", "own", "d_own", "d_next")
                if opened is None or not np.array_equal(opened, ids):
                    if opened is not None:
                        yield told(opened, cost)
                    opened, cost = ids, np.zeros((len(closed), len(ids)))
                order = np.argsort(own, kind="stable")
                x, own, d_own, d_next = x[order], own[order], d_own[order], d_next[order]
                product = blocks.Product(x, q)
                for a in range(0, len(x), 32):  # stays in the cache
                    d = product.distances(a, a + 32)
                    stay = np.fmin(d, d_own[a : a + 32, None])
                    lost = np.fmin(d, d_next[a : a + 32, None], out=d)
                    cost += stay.sum(0)
                    lost -= stay
                    edge = np.flatnonzero(np.diff(own[a : a + 32], prepend=own[a] - 1))
                    cost[np.searchsorted(closed, own[a : a + 32][edge])] += np.add.reduceat(lost, edge)
        if opened is not None:
            yield told(opened, cost)

    return run


def swap_costs(points: DataFrame, centers: DataFrame, candidates: DataFrame, whole: bool = False) -> DataFrame:
    """closed (cid), opened (id), cost: for every pair of a centre and a candidate. Centres
    and candidates are small tables (k and the candidates of a round). whole: any number of
    candidates, which meet the points block by block, with none of them broadcast."""
    near = points.select("id", "v").join(small(centers.select("cid", F.col("v").alias("c"))))
    near = near.select("id", "v", "cid", vec.d2("v", "c").alias("d2"))
    two = near.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("d2", "cid"))).where("r <= 2")
    two = two.groupBy("id").agg(F.first("v").alias("v"), F.min(F.when(F.col("r") == 1, F.col("cid"))).alias("own"), F.min(F.when(F.col("r") == 1, F.col("d2"))).alias("d_own"), F.min(F.when(F.col("r") == 2, F.col("d2"))).alias("d_next"))
    news = candidates.select(F.col("id").alias("opened"), F.col("v").alias("q"))
    if whole:
        two = two.select("v", "own", "d_own", F.coalesce("d_next", F.lit(float("inf"))).alias("d_next"))
        pairs = blocks.met(blocks.spread(news.withColumnRenamed("q", "v"), "q"), blocks.spread(stored(two, "two-nearest"), "p"))
        parts = pairs.mapInArrow(_sums(sorted(r["cid"] for r in centers.select("cid").collect())), "opened long, closed long, cost double")
        return parts.groupBy("closed", "opened").agg(F.sum("cost").alias("cost"))
    tried = two.join(small(news)).select("opened", "own", "d_own", "d_next", vec.d2("v", "q").alias("d_new"))
    open_cost = F.least("d_own", "d_new")
    closed_cost = F.least(F.coalesce("d_next", F.lit(float("inf"))), F.col("d_new"))
    sums = tried.groupBy("opened", F.col("own").alias("closed")).agg(F.sum(open_cost).alias("stay"), F.sum(closed_cost).alias("lost"))
    every = sums.groupBy("opened").agg(F.sum("stay").alias("all_stay"))
    pairs = F.broadcast(centers.select(F.col("cid").alias("closed"))).join(every)
    scored = pairs.join(sums, ["opened", "closed"], "left")
    return scored.select("closed", "opened", (F.col("all_stay") + F.coalesce(F.col("lost") - F.col("stay"), F.lit(0.0))).alias("cost"))


def best_swap(points: DataFrame, centers: DataFrame, candidates: DataFrame) -> DataFrame:
    return swap_costs(points, centers, candidates).orderBy("cost", "opened", "closed").limit(1)


def local_search(points: DataFrame, centers: DataFrame, samples: int = 10, rounds: int = 20, seed: int = 1) -> DataFrame:
    """Swaps while one of a round's candidates (drawn in proportion to the cost) improves."""
    from coreloom.operators.assign import nearest

    spark = points.sparkSession
    cost = nearest(points, centers).agg(F.sum("d2")).first()[0] or 0.0
    for r in range(rounds):
        near = nearest(points, centers)
        drawn = near.withColumn("_p", rng.priority(rng.uniform(seed, F.lit(r), "id"), F.col("d2"))).where("_p is not null").orderBy("_p", "id").limit(samples).select("id", "v")
        found = best_swap(points, centers, drawn).collect()
        if not found or not found[0]["cost"] < cost * (1 - 1e-12):
            break
        cost = found[0]["cost"]
        new = points.where(F.col("id") == found[0]["opened"]).select("v").first()["v"]
        rows = [(x["cid"], list(new) if x["cid"] == found[0]["closed"] else list(x["v"])) for x in centers.collect()]
        centers = spark.createDataFrame(rows, "cid long, v array<double>")
    return centers


def permutations(n: int, k: int):
    """The k-permutations of range(n), in order."""
    import itertools

    return itertools.permutations(range(n), k)
