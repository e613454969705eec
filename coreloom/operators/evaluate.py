"""Costs, distortions, candidate solutions, balls and the evaluation of hard instances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import rng, vec
from coreloom.operators import aggregates, blocks, hard_instance
from coreloom.operators.assign import matrix, nearest, squared


def cost(points: DataFrame, centers: DataFrame, added_mass: float = 0.0) -> DataFrame:
    """One row: the (weighted, if points have w) sum of squared distances."""
    w = F.col("w") if "w" in points.columns else F.lit(1.0)
    return nearest(points, centers).agg((F.coalesce(F.sum(w * F.col("d2")), F.lit(0.0)) + added_mass).alias("cost"))


def coreset_points(coreset: DataFrame) -> DataFrame:
    """A coreset as weighted points with ids of their own."""
    return coreset.select(F.xxhash64("idx", "is_center").alias("id"), "v", "w")


def distortions(points: DataFrame, coreset: DataFrame, solutions: list[DataFrame], added_mass: float = 0.0) -> DataFrame:
    """solution, real_cost, coreset_cost, distortion: a row a candidate solution."""
    out = None
    own = coreset_points(coreset)
    for i, centers in enumerate(solutions):
        real = cost(points, centers).select(F.lit(i).alias("solution"), F.col("cost").alias("real_cost"))
        small = cost(own, centers, added_mass).select(F.col("cost").alias("coreset_cost"))
        row = real.join(F.broadcast(small))
        out = row if out is None else out.unionAll(row)
    return out.withColumn("distortion", vec.distortion("real_cost", "coreset_cost"))


def candidate_solutions(coreset: DataFrame, k: int, seeds=(1, 2, 3, 4, 5), iterations: int = 300) -> list[DataFrame]:
    """Weighted k-means++ and Lloyd on the coreset, once a seed."""
    from coreloom.operators.lloyd import lloyd
    from coreloom.operators.seeding import kmeanspp

    own = coreset_points(coreset.where("w > 0"))
    found = [lloyd(own, kmeanspp(own, k, s, weighted=True), iterations)[0] for s in seeds]
    for centers in found:
        require_finite(centers)
    return found


def require_finite(centers: DataFrame) -> None:
    """Raises if a coordinate of a centre is NaN or infinite."""
    bad = centers.where(F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).limit(1).count()
    if bad:
        raise ValueError("a centre has a coordinate that is not finite")


def farthest_row(points: DataFrame, center: list[float]) -> DataFrame:
    """The point farthest from a centre (lowest id of several): id, v, d2."""
    c = F.array(*[F.lit(float(x)) for x in center])
    return points.select("id", "v", vec.d2("v", c).alias("d2")).orderBy(F.desc("d2"), "id").limit(1)


def _farthest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, d = b.column(0).to_numpy(), ((matrix(b.column(1)) - shared.value) ** 2).sum(1)
            i = np.lexsort((ids, -d))[0]
            if best is None or (-d[i], ids[i]) < best[:2]:
                best = -d[i], ids[i], b.column(1).slice(i, 1)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[1]]), best[2], pa.array([-best[0]])], names=["id", "v", "d2"])

    return run


def farthest(points: DataFrame, center: list[float]):
    """The point of ``farthest_row`` as a Row. The centre is broadcast, so that a loop over
    centres compiles its plan once, and each partition answers with one point."""
    shared = points.sparkSession.sparkContext.broadcast(np.array(center, np.float64))
    rows = points.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_farthest(shared), "id long, v array<double>, d2 double")
    return rows.orderBy(F.desc("d2"), "id").limit(1).collect()[0]


def enclosing_ball(points: DataFrame, iterations: int = 100) -> tuple[list[float], float]:
    """(centre, radius) by moving the centre towards the farthest point by 1/(i+1)."""
    c = [float(x) for x in points.orderBy("id").limit(1).select("v").first()["v"]]
    for i in range(1, iterations + 1):
        far = farthest(points, c)
        c = [a + (b - a) / (i + 1) for a, b in zip(c, far["v"])]
    return c, float(farthest(points, c)["d2"]) ** 0.5


def random_in_ball(spark, center: list[float], radius: float, n: int, seed) -> DataFrame:
    """n points: the centre plus a random direction times a random length."""
    d = len(center)
    raw = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda p: rng.normal(seed, F.col("id"), p))
    rows = spark.range(n).withColumn("raw", raw)
    length = F.lit(float(radius)) * rng.uniform(f"{seed}l", "id") / F.sqrt(vec.norm2("raw"))
    c = F.array(*[F.lit(float(x)) for x in center])
    return rows.select(F.col("id").alias("cid"), F.zip_with(c, "raw", lambda a, x: a + x * length).alias("v"))


def convex_candidates(centers: DataFrame, n: int, seed) -> DataFrame:
    """n convex combinations of two centres drawn with replacement. centers: cid, v."""
    spark = centers.sparkSession
    ranked = centers.select("v", F.row_number().over(W.orderBy("cid")).alias("r"))  # k rows
    k = ranked.count()
    pick = lambda tag: (F.floor(rng.uniform(f"{seed}{tag}", "id") * k) + 1).cast("int")
    wa, wb = rng.uniform(f"{seed}wa", "id"), rng.uniform(f"{seed}wb", "id")
    rows = spark.range(n).select("id", pick("a").alias("ra"), pick("b").alias("rb"), (wa / (wa + wb)).alias("t"))
    rows = rows.join(F.broadcast(ranked.select(F.col("r").alias("ra"), F.col("v").alias("va"))), "ra")
    rows = rows.join(F.broadcast(ranked.select(F.col("r").alias("rb"), F.col("v").alias("vb"))), "rb")
    return rows.select(F.col("id").alias("cid"), F.zip_with("va", "vb", lambda x, y: F.col("t") * x + (1.0 - F.col("t")) * y).alias("v"))


def _snapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks the nearest point (lowest id of several) of each coreset row."""
    for b in batches:
        for row in range(b.num_rows):
            c, idx, w = blocks.side(b, row, "c", "idx", "w")
            x, ids = blocks.side(b, row, "p", "id")
            order = np.argsort(ids, kind="stable")
            place, d = squared(c, x[order])
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(w), pa.array(ids[order][place]), pa.array(d)], names=["idx", "w", "id", "d2"])


def snap(coreset: DataFrame, points: DataFrame) -> DataFrame:
    """idx, w, id: the dataset point nearest to each coreset point. Blocks of both sides meet,
    and a pair of blocks answers with a row for each coreset row. The points stay in their
    partitions; a coreset of more than a block is dealt, so that few partitions of points
    still make enough tasks."""
    coreset = coreset.select("idx", "v", F.col("w").cast("double").alias("w"))
    parts = min(64, coreset.count() // blocks.ROWS + 1)
    c = blocks.packed(coreset.repartition(parts), "c")
    pairs = blocks.met(c, blocks.packed(points.select("id", "v"), "p"))
    rows = pairs.mapInArrow(_snapped, "idx long, w double, id long, d2 double")
    best = rows.groupBy("idx").agg(F.min(F.struct("d2", "id")).alias("x"), F.first("w").alias("w"))
    return best.select("idx", "w", "x.id")


EPSILONS = (0.01, 0.05, 0.1, 0.3, 0.5)


def hard_instance_eval(points: DataFrame, coreset: DataFrame, k: int, alpha: int, epsilons=EPSILONS) -> DataFrame:
    """block_index, epsilon, n_non_deficient_centers, coreset_cost, real_cost, distortion.

    All blocks and epsilons in one query. For each block the clusters whose snapped coreset
    mass is at least size * (1 - epsilon) give their means as centres; costs are 0 where no
    cluster does."""
    blocks = F.explode(F.array(*[F.lit(a) for a in range(alpha)])).alias("a")
    labelled = points.select("id", "v", blocks).withColumn("i", hard_instance.block_cluster(k, F.col("a")))
    sizes = labelled.groupBy("a", "i").agg(F.count("*").alias("n"))
    means = labelled.select("a", "i", F.posexplode("v").alias("pos", "x")).groupBy("a", "i", "pos").agg(F.avg("x").alias("x"))
    means = means.groupBy("a", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    mass = snap(coreset, points).select("id", "w", blocks).withColumn("i", hard_instance.block_cluster(k, F.col("a"))).groupBy("a", "i").agg(F.sum("w").alias("mass"))
    eps = F.explode(F.array(*[F.lit(float(e)) for e in epsilons])).alias("epsilon")
    good = sizes.join(mass, ["a", "i"], "left").join(means, ["a", "i"]).select("a", "i", "n", F.coalesce("mass", F.lit(0.0)).alias("mass"), "c", eps)
    good = good.where(F.col("mass") >= F.col("n") * (1.0 - F.col("epsilon"))).select("a", "epsilon", "c")

    def costs(rows: DataFrame, name: str) -> DataFrame:
        pairs = rows.join(F.broadcast(good))  # at most alpha * |epsilons| * k centres
        near = pairs.groupBy("a", "epsilon", "id").agg(F.min(vec.d2("v", "c")).alias("d2"), F.first("w").alias("w"))
        return near.groupBy("a", "epsilon").agg(F.sum(F.col("w") * F.col("d2")).alias(name))

    spark = points.sparkSession
    every = spark.range(alpha).select(F.col("id").cast("int").alias("a"), eps)
    counted = good.groupBy("a", "epsilon").agg(F.count("*").alias("n_non_deficient_centers"))
    real = costs(points.select("id", "v", F.lit(1.0).alias("w")), "real_cost")
    small = costs(coreset.select(F.col("idx").alias("id"), "v", "w"), "coreset_cost")
    keys = ["a", "epsilon"]
    out = every.join(counted, keys, "left").join(real, keys, "left").join(small, keys, "left").fillna(0, ["n_non_deficient_centers", "real_cost", "coreset_cost"])
    return out.select(F.col("a").alias("block_index"), "epsilon", "n_non_deficient_centers", "coreset_cost", "real_cost", vec.distortion("real_cost", "coreset_cost").alias("distortion"))
