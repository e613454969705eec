"""Draws from tables: by weight with replacement, uniform in groups, without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import rng

#: Buckets of the two-level prefix sum.
BUCKETS = 64


def weighted_choice(items: DataFrame, draws: int, seed, buckets: int = BUCKETS) -> DataFrame:
    """items: id, w (>= 0) -> (draw, id): ``draws`` draws with replacement in proportion to w.

    Inverse of the cumulative weights in the order (id mod buckets, id). Bucket totals (few
    rows) place each draw in a bucket; inside a bucket items and draws are merged by sorting
    on the cumulative weight, so the work is linear and no bucket holds all rows."""
    spark = items.sparkSession
    rows = items.where("w > 0").select("id", F.col("w").cast("double").alias("w"), F.pmod("id", F.lit(buckets)).alias("b"))
    totals = rows.groupBy("b").agg(F.sum("w").alias("bw"), F.max("id").alias("top"))
    up = F.sum("bw").over(W.orderBy("b"))  # at most ``buckets`` rows
    totals = totals.withColumn("hi", up).withColumn("lo", F.col("hi") - F.col("bw")).withColumn("all", F.sum("bw").over(W.partitionBy()))
    last = F.max("b").over(W.partitionBy())
    totals = totals.withColumn("last", last)
    asked = spark.range(draws).select(F.col("id").alias("draw"), rng.uniform(seed, F.col("id")).alias("u"))
    t = F.broadcast(totals)
    placed = asked.join(t, (F.col("u") * F.col("all") >= F.col("lo")) & ((F.col("u") * F.col("all") < F.col("hi")) | (F.col("b") == F.col("last"))))
    placed = placed.select("b", (F.col("u") * F.col("all") - F.col("lo")).alias("pos"), F.lit(1).alias("kind"), "draw", F.lit(None).cast("long").alias("id"), "top")
    run = F.sum("w").over(W.partitionBy("b").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    own = rows.select("b", run.alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("draw"), "id", F.lit(None).cast("long").alias("top"))
    # from the end on, a running value: a frame that ends at the end is read again for every row
    down = W.partitionBy("b").orderBy(F.desc("pos"), F.desc("kind"), F.desc("draw"), F.desc("id"))
    after = F.last("id", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0))
    merged = own.unionByName(placed).withColumn("hit", F.coalesce(after, "top"))  # top: rounding at the very end
    return merged.where("kind = 1").select("draw", F.col("hit").alias("id"))


def weighted_choice_sql(items: str, draws: int, seed, buckets: int = BUCKETS) -> str:
    """DuckDB: (draw, id) from a relation with id, w."""
    return f"""
SELECT draw, arg_min(id, hi) AS id FROM (
  SELECT i AS draw, {rng.uniform_sql(seed, 'i')} * (SELECT sum(w) FROM {items}) AS u FROM range({draws}) t(i)) d
JOIN (SELECT id, sum(w) OVER (ORDER BY id % {buckets}, id) AS hi FROM {items} WHERE w > 0) c ON c.hi > d.u
GROUP BY draw"""


def draw_one(items: DataFrame, seed, *keys) -> DataFrame:
    """One draw in proportion to w: (id, v, ...) of the smallest priority."""
    best = items.withColumn("_p", rng.priority(rng.uniform(seed, "id", *keys), F.col("w")))
    return best.where("_p is not null").orderBy("_p", "id").limit(1).drop("_p")


def uniform_choice(items: DataFrame, group: str, counts: DataFrame, seed) -> DataFrame:
    """counts: group, m -> m uniform draws with replacement in each group: (group, draw, id)."""
    ranked = items.select(group, "id", F.row_number().over(W.partitionBy(group).orderBy("id")).alias("_r"))
    sizes = items.groupBy(group).agg(F.count("*").alias("_n"))
    asked = counts.join(sizes, group).where("m > 0").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    asked = asked.withColumn("_r", (F.floor(rng.uniform(seed, group, "draw") * F.col("_n")) + 1).cast("int"))
    return asked.join(ranked, [group, "_r"]).select(group, "draw", "id")


def sample_without_replacement(items: DataFrame, n: int, seed) -> DataFrame:
    """n distinct rows, each set alike: the n smallest hashes (a top-n, not a sort)."""
    return items.withColumn("_u", rng.uniform(seed, "id")).orderBy("_u", "id").limit(n).drop("_u")


def weighted_reservoir(items: DataFrame, n: int, seed) -> DataFrame:
    """n distinct rows by weight: the n smallest priorities."""
    return items.withColumn("_p", rng.priority(rng.uniform(seed, "id"), F.col("w"))).where("_p is not null").orderBy("_p", "id").limit(n).drop("_p")
