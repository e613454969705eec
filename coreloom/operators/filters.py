"""Row selections over points, assignments and experiment files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import vec


def gather(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose id is in ``ids``."""
    return points.join(ids.select("id").distinct(), "id", "left_semi")


def cluster_points(assigned: DataFrame, cluster: int) -> DataFrame:
    return assigned.where(F.col("cluster") == cluster)


def overshot_points(ringed: DataFrame, cluster: int | None = None) -> DataFrame:
    rows = ringed.where("kind = 'overshot'")
    return rows if cluster is None else rows.where(F.col("cluster") == cluster)


def finite_rows(points: DataFrame) -> DataFrame:
    """Rows without a NaN coordinate."""
    return points.where(~vec.has_nan("v"))


def bad_coordinates(points: DataFrame) -> DataFrame:
    """n_nan, n_inf over all coordinates."""
    x = points.select(F.explode("v").alias("x"))
    return x.agg(F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"))


def intersection(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_semi")


def difference(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_anti")


def pair_reduced_files(files: DataFrame, pattern: str = r"-svd-d\d+") -> DataFrame:
    """reduced, original: files whose name without ``pattern`` is another file's. files: path."""
    reduced = files.where(F.col("path").rlike(pattern)).select(F.col("path").alias("reduced"), F.regexp_replace("path", pattern, "").alias("original"))
    return reduced.join(files.select(F.col("path").alias("original")), "original").select("reduced", "original")


def ordered(values: DataFrame, key: str, value: str, item: str) -> DataFrame:
    """In each group the rank of every row by value (from 0), and prefix sums of x and x * x."""
    w = W.partitionBy(key).orderBy(value, item)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    return values.select(key, item, (F.row_number().over(w) - 1).cast("long").alias("rank"), F.sum(value).over(run).alias("sum"), F.sum(F.col(value) * F.col(value)).over(run).alias("sum2"))
