"""Writers: coresets, centres, sketches, matrices and metrics. Spark's ``_SUCCESS`` file is the completion marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(x: Column, digits: int | None) -> Column:
    return x.cast("string") if digits is None else F.format_string(f"%.{digits}g", x)


def weighted_text(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """value: ``w x1 .. xd``; full precision, or so many significant digits."""
    parts = F.transform(F.concat(F.array(F.col("w").cast("double")), F.col("v").cast("array<double>")), lambda x: _number(x, digits))
    return rows.select(F.array_join(parts, " ").alias("value"))


def write_coreset(coreset: DataFrame, path: str, digits: int | None = None) -> None:
    """Gzip text: the number of rows first. One file, as a coreset is small by construction."""
    spark = coreset.sparkSession
    body = weighted_text(coreset, digits)
    head = spark.createDataFrame([(str(coreset.count()), 0)], "value string, at int")
    head.unionAll(body.withColumn("at", F.lit(1))).coalesce(1).sortWithinPartitions("at").select("value").write.option("compression", "gzip").text(path)


def write_centers(centers: DataFrame, path: str) -> None:
    """Each line with the weight 1 before the coordinates."""
    weighted_text(centers.orderBy("cid").withColumn("w", F.lit(1.0))).coalesce(1).write.text(path)


def write_dense(points: DataFrame, path: str, transpose: bool = False) -> None:
    """Headerless CSV, gzip; the rows in the order of ids."""
    rows = points.select("id", "v")
    if transpose:
        rows = rows.select("id", F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("s"))
        rows = rows.select(F.col("pos").alias("id"), F.col("s.x").alias("v"))
    rows.orderBy("id").select(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("value")).write.option("compression", "gzip").text(path)


def write_sparse(cells: DataFrame, path: str) -> None:
    """Triples from 1, nonzero cells alone."""
    rows = cells.where("val <> 0").orderBy("row", "col")
    rows.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("value")).write.option("compression", "gzip").text(path)


def append_metric(spark, path: str, name: str, value: float, run: str) -> None:
    spark.createDataFrame([(run, name, float(value))], "run string, name string, value double").write.mode("append").parquet(path)


def write_pca(spark, path: str, mean, components, variances) -> None:
    """One small table: component, variance, vector; component 0 is the mean."""
    rows = [(0, None, [float(x) for x in mean])] + [(i + 1, float(v), [float(x) for x in components[:, i]]) for i, v in enumerate(variances)]
    spark.createDataFrame(rows, "component int, variance double, vector array<double>").coalesce(1).write.parquet(path)
