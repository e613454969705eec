"""Sparse matrices as long tables cells(row, col, val), bag-of-words tables, CSR rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.session import stored


def dense_ids(values: DataFrame, column: str, start: int = 0) -> DataFrame:
    """(column, id): ranks of the distinct values in order, without gathering them: ranges
    are sorted apart, and only their sizes meet in one task."""
    rows = values.select(column).where(F.col(column).isNotNull()).distinct()
    rows = rows.repartitionByRange(column).sortWithinPartitions(column)
    rows = stored(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_at") + start).alias("id"))


def word_counts(documents: DataFrame) -> DataFrame:
    """doc_id, word, cnt of words [a-z]+ in the lower-cased text."""
    words = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word")
    return documents.select("doc_id", words).where("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("cnt"))


def bag_of_words(documents: DataFrame) -> DataFrame:
    """doc_id, word_id (from 1, in the order of words), cnt."""
    counts = stored(word_counts(documents), "word-counts")  # read twice below
    ids = dense_ids(counts, "word", 1)
    return counts.join(ids, "word").select("doc_id", F.col("id").alias("word_id"), "cnt")


def cells_of(bag: DataFrame, compact_rows: bool = False, transpose: bool = False) -> DataFrame:
    """Zero-based cells of a bag of words. ``compact_rows`` numbers the documents that have
    words; otherwise a document's row is its id - 1."""
    if compact_rows:
        ids = dense_ids(bag, "doc_id").select("doc_id", F.col("id").alias("row"))
        bag = bag.join(ids, "doc_id")
    else:
        bag = bag.withColumn("row", F.col("doc_id") - 1)
    row, col = ("row", F.col("word_id") - 1) if not transpose else (F.col("word_id") - 1, "row")
    return bag.select(F.col(row).alias("row") if isinstance(row, str) else row.alias("row"), F.col(col).alias("col") if isinstance(col, str) else col.alias("col"), F.col("cnt").cast("double").alias("val"))


def csr(cells: DataFrame) -> DataFrame:
    """row, cols, vals, start: rows in compressed form; start is the cells before the row."""
    rows = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("x"))
    parts = rows.select("row", F.col("x.col").alias("cols"), F.col("x.val").alias("vals"), F.size("x").alias("n"))
    bucket = parts.withColumn("b", F.floor(F.col("row") / 4096))
    sums = bucket.groupBy("b").agg(F.sum("n").alias("bn"))
    before = sums.select("b", F.coalesce(F.sum("bn").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n").over(W.partitionBy("b").orderBy("row")) - F.col("n")
    return bucket.join(F.broadcast(before), "b").select("row", "cols", "vals", (F.col("before") + own).alias("start"))


def lookup(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: row, col -> also val, 0 where there is no cell."""
    return asked.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("val", F.lit(0.0)).alias("val"))


def densify(cells: DataFrame, width: int) -> DataFrame:
    """id, v: rows as arrays of the given width; repeated cells add up."""
    sums = cells.groupBy("row", "col").agg(F.sum("val").alias("val"))
    maps = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    return maps.select(F.col("row").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("v"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
