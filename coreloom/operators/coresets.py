"""Coreset constructions. A coreset is (idx, is_center, w, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions import rng, vec
from coreloom.operators import aggregates, rings, sampling
from coreloom.operators.assign import nearest, ray_assign
from coreloom.operators.kmeans1d import kmeans_1d
from coreloom.operators.seeding import kmeanspp
from coreloom.session import stored


def merge(rows: DataFrame) -> DataFrame:
    """Add up the weights of equal (idx, is_center)."""
    return rows.groupBy("idx", "is_center").agg(F.sum("w").alias("w"), F.first("v").alias("v"))


def _assigned(points: DataFrame, centers: DataFrame) -> DataFrame:
    """id, v, cluster, d2, cost (unsquared)."""
    return nearest(points.select("id", F.col("v").cast("array<double>").alias("v")), centers).withColumn("cost", F.sqrt("d2"))


def basic(points: DataFrame, m: int, seed=1) -> DataFrame:
    """Means of the clusters of m seeds, weighted by their sizes."""
    own = stored(_assigned(points, kmeanspp(points, m, seed)), "assigned")
    sizes = own.groupBy("cluster").agg(F.count("*").cast("double").alias("w"))
    means = aggregates.centroids(own)
    return means.join(sizes, means["cid"] == sizes["cluster"]).select(F.col("cid").alias("idx"), F.lit(True).alias("is_center"), "w", "v")


def stream_km(points: DataFrame, m: int, seed=1) -> DataFrame:
    """The m seeds themselves, weighted by the points nearest to them."""
    seeds = kmeanspp(points, m, seed)
    sizes = _assigned(points, seeds).groupBy("cluster").agg(F.count("*").cast("double").alias("w"))
    return seeds.join(sizes, seeds["cid"] == sizes["cluster"]).select(F.col("cid").alias("idx"), F.lit(False).alias("is_center"), "w", "v")


def sensitivity(points: DataFrame, k: int, m: int, seed=1, centers: DataFrame | None = None) -> DataFrame:
    """m draws in proportion to the cost, and the means of the clusters with the weight that the draws leave."""
    centers = kmeanspp(points, 2 * k, seed) if centers is None else centers
    own = stored(_assigned(points, centers), "assigned")
    draws = sampling.weighted_choice(own.select("id", F.col("cost").alias("w")), m, f"{seed}s")
    whole = own.agg(F.sum("cost").alias("whole"))
    picked = own.join(draws.groupBy("id").agg(F.count("*").alias("times")), "id").join(F.broadcast(whole))
    weight = F.col("times") * F.col("whole") / (F.lit(float(m)) * F.col("cost"))
    sampled = picked.select("id", "cluster", weight.alias("w"), "v")
    used = sampled.groupBy("cluster").agg(F.sum("w").alias("used"))
    sizes = own.groupBy("cluster").agg(F.count("*").cast("double").alias("n")).join(used, "cluster", "left")
    means = aggregates.centroids(own)
    tops = means.join(sizes, means["cid"] == sizes["cluster"])
    tops = tops.select(F.col("cid").alias("idx"), F.lit(True).alias("is_center"), F.greatest(F.lit(0.0), F.col("n") - F.coalesce("used", F.lit(0.0))).alias("w"), "v")
    return merge(sampled.select(F.col("id").alias("idx"), F.lit(False).alias("is_center"), "w", "v")).unionByName(tops)


def group_sampling(points: DataFrame, k: int, m: int, seed=1, centers: DataFrame | None = None, beta: int = rings.BETA, least: float = 1.0) -> DataFrame:
    """Shortfall and small groups go to their cluster's mean, groups that fit are kept, the
    others are drawn from uniformly."""
    centers = kmeanspp(points, 2 * k, seed) if centers is None else centers
    own = stored(rings.ring_points(_assigned(points, centers), beta=beta), "rings")
    plan = rings.sample_plan(own, m, least=least)
    name = F.concat_ws("/", "kind", "cluster", F.coalesce(F.col("ring").cast("string"), F.lit("x")))
    plan = stored(plan.withColumn("grp", name).select("grp", "cluster", "n", "group_cost", "action", "draws"), "plan")
    members = own.where("kind <> 'shortfall'").withColumn("grp", name).select("grp", "id", "v", "cost", F.col("cluster").alias("of"))
    means = aggregates.centroids(own).select(F.col("cid").alias("idx"), "v")
    short = own.where("kind = 'shortfall'").groupBy("cluster").agg(F.count("*").cast("double").alias("w"))
    snapped = plan.where("action = 'snap'").groupBy("cluster").agg(F.sum("n").cast("double").alias("w"))
    tops = short.unionByName(snapped).groupBy(F.col("cluster").alias("idx")).agg(F.sum("w").alias("w"))
    tops = tops.join(means, "idx").select("idx", F.lit(True).alias("is_center"), "w", "v")
    kept = members.join(plan.where("action = 'keep'").select("grp"), "grp").select(F.col("id").alias("idx"), F.lit(False).alias("is_center"), F.lit(1.0).alias("w"), "v")
    queued = plan.where("action = 'sample'").withColumn("m", rng.stochastic_round("draws", rng.uniform(f"{seed}r", "grp")))
    inside = members.join(queued.select("grp"), "grp")
    picks = sampling.uniform_choice(inside.select("grp", "id"), "grp", queued.select("grp", "m"), f"{seed}g")
    drawn = picks.join(inside, ["grp", "id"]).join(queued.select("grp", "group_cost", "draws"), "grp")
    drawn = drawn.select(F.col("id").alias("idx"), F.lit(False).alias("is_center"), (F.col("group_cost") / (F.col("draws") * F.col("cost"))).alias("w"), "v")
    return tops.unionByName(merge(kept.unionByName(drawn)))


def make_rays(assigned: DataFrame, centers: DataFrame, m: int, seed=1, most: int = 20) -> DataFrame:
    """cluster, ray, origin, dir: random unit directions, more for larger clusters."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    k = max(1, sizes.count())
    rays = F.least(F.lit(most), F.ceil(F.col("n") / F.lit(2.0 * m / k))).cast("int")
    rows = sizes.join(centers, sizes["cluster"] == centers["cid"]).select("cluster", F.col("v").alias("origin"), F.explode(F.sequence(F.lit(1), F.greatest(rays, F.lit(1)))).alias("ray"))
    raw = F.transform(F.sequence(F.lit(1), F.size("origin")), lambda p: rng.normal(seed, F.col("cluster"), F.col("ray"), p))
    rows = rows.withColumn("raw", raw)
    length = F.sqrt(vec.norm2("raw"))
    return rows.select("cluster", "ray", "origin", F.transform("raw", lambda x: x / length).alias("dir"))


def ray_maker(points: DataFrame, k: int, m: int, seed=1, conserve_mass: bool = False) -> DataFrame:
    """Exact one-dimensional k-means of the projections on random rays; the mean of each
    interval of more than one point (with ``conserve_mass`` of every one)."""
    seeds = kmeanspp(points, 2 * k, seed)
    own = stored(_assigned(points, seeds), "assigned")
    clusters = max(1, own.select("cluster").distinct().count())
    near = ray_assign(own.select("id", "v", "cluster"), make_rays(own, seeds, m, seed))
    sizes = near.groupBy("cluster", "ray").agg(F.count("*").alias("n_ray"))
    whole = own.groupBy("cluster").agg(F.count("*").alias("n_c"))
    parts = sizes.join(whole, "cluster").select("cluster", "ray", F.ceil(F.col("n_ray") / F.col("n_c") * F.lit(m / clusters)).cast("int").alias("parts"))
    near = stored(near, "on-rays")
    labels = kmeans_1d(near.join(parts, ["cluster", "ray"]).select("cluster", "ray", "id", "length", "parts"), ["cluster", "ray"], "length", "parts")
    pieces = near.select("id", "v").join(labels.select("id", "cluster", "ray", "label"), "id")
    pieces = pieces.select("id", "v", F.xxhash64("cluster", "ray", "label").alias("cluster"))
    counts = pieces.groupBy("cluster").agg(F.count("*").cast("double").alias("w"))
    if not conserve_mass:
        counts = counts.where("w > 1")
    means = aggregates.centroids(pieces)
    return means.join(counts, means["cid"] == counts["cluster"]).select(F.col("cid").alias("idx"), F.lit(True).alias("is_center"), "w", "v")
