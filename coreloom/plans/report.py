"""Reports over result tables: summaries, pivots, ratios, normalisation, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(results: DataFrame, keys: list[str], value: str, order: str, first: int = 10) -> DataFrame:
    """count, mean, sample standard deviation, median and maximum of each group's first rows."""
    rows = results.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= first)
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.max(value).alias("max"))


def pivot(results: DataFrame, keys: list[str], column: str, values: list[str], value: str, how: str = "mean") -> DataFrame:
    agg = {"mean": F.avg(value), "max": F.max(value), "join": F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ", ")}[how]
    return results.groupBy(*keys).pivot(column, values).agg(agg)


def facts(results: DataFrame, factor: int | None = None, without=(), least_k: dict[str, int] | None = None) -> DataFrame:
    """Rows of one coreset size factor, of none of the data sets ``without``, and with k at
    least the value of each name in ``least_k`` that the data set's name contains. A null
    data set is none of the names and stays."""
    if factor is not None:
        results = results.where(F.col("coreset_size_factor") == factor)
    if without:
        results = results.where(F.coalesce(~F.col("dataset").isin(*without), F.lit(True)))
    for name, k in (least_k or {}).items():
        results = results.where(F.coalesce(~F.col("dataset").contains(name), F.lit(True)) | (F.col("k") >= k))
    return results


def latex_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``line``, the row of a LaTeX table: cells with special signs escaped,
    null cells empty."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")
    return rows.withColumn("line", F.concat(F.concat_ws(" & ", *[cell(c) for c in columns]), F.lit(r" \\")))


def ratio(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    out = results.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return out.withColumn("ratio", F.try_divide("high", "low"))


def minmax(results: DataFrame, key: str, value: str, name: str = "norm") -> DataFrame:
    w = W.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return results.withColumn(name, F.try_divide(F.col(value) - low, high - low))


def mean_std(mean, std, digits: int = 2) -> Column:
    """``mean (std)``, ties to the even digit; a value that is null, such as the deviation of
    one row, is ``nan``."""
    text = lambda x, n: F.coalesce(F.when(F.isnotnull(x), F.format_string(f"%.{n}f", F.bround(x, n))), F.lit("nan"))
    return F.concat(text(mean, digits), F.lit(" ("), text(std, digits + 1), F.lit(")"))


def duration(seconds: Column) -> Column:
    """``00h 00m 00s``"""
    s = seconds.cast("long")
    return F.format_string("%02dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def k_label(k: Column) -> Column:
    return F.concat(F.lit("k="), k.cast("string"))


def instance_parameters(path: Column) -> Column:
    """struct(k, alpha, beta) from a hard instance's file name."""
    pattern = r"k(\d+)-alpha(\d+)-beta(\d+(?:\.\d+)?)"
    return F.struct(*[F.regexp_extract(path, pattern, i).cast(t).alias(n) for i, (n, t) in enumerate((("k", "int"), ("alpha", "int"), ("beta", "double")), 1)])


def dataset_label(path: Column, labels: list[tuple[str, str]]) -> Column:
    """The label of the first part that the path contains."""
    out = F.lit(None).cast("string")
    for part, label in reversed(labels):
        out = F.when(path.contains(part), label).otherwise(out)
    return out


def custom_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return rows.orderBy(F.when(at == 0, len(order) + 1).otherwise(at), column)
