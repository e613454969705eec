"""Readers of point sets, bags of words, coresets and centres. All give (id, v) or long tables.

Gzip is found by the file's suffix; a gzip file is one partition, so large ones are dealt
out after the scan. ``id`` follows the line order: the file's lines are numbered by
(partition, place), which keeps the order without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.operators import hard_instance

NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def lines(spark: SparkSession, path: str, keep: str = "true") -> DataFrame:
    """ln (from 0, without gaps), value: the numbered lines of a text file, of those that ``keep``."""
    rows = spark.read.text(path).where(keep).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"), "value")
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = sizes.select("p", "first", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.join(F.broadcast(before), "p").select((F.col("at") - F.col("first") + F.col("before")).alias("ln"), "value")
    return out.repartition("ln") if path.endswith(".gz") else out


def numbers(value: Column, separator: str = ",") -> Column:
    """array<double> of a line; a part that is no number raises."""
    parts = F.transform(F.split(F.trim(value), separator), lambda x: F.trim(x))
    bad = F.exists(parts, lambda x: ~x.rlike(NUMBER))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number in: "), value)).cast("array<double>")).otherwise(parts.cast("array<double>"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Ids without gaps for the rows that are left, in line order."""
    return rows.select(F.col("ln").alias("id"), "v")


def dense_csv(spark: SparkSession, path: str) -> DataFrame:
    """Width from the first line; blank lines and lines of another width are skipped; text raises."""
    rows = lines(spark, path)
    first = rows.where("trim(value) <> ''").orderBy("ln").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "id long, v array<double>")
    width = first[0]["value"].count(",") + 1
    rows = rows.where((F.trim("value") != "") & (F.size(F.split("value", ",")) == width))
    return _numbered(rows.select("ln", numbers(F.col("value")).alias("v")))


def census(spark: SparkSession, path: str, width: int = 68) -> DataFrame:
    """Header skipped, first attribute dropped, other widths skipped."""
    rows = lines(spark, path).where("ln > 0").where(F.size(F.split("value", ",")) == width + 1)
    return _numbered(rows.select("ln", F.slice(numbers(F.col("value")), 2, width).alias("v")))


def covertype(spark: SparkSession, path: str, width: int = 54, expected: int | None = None) -> DataFrame:
    """Last attribute (the class) dropped; fewer rows than expected raise."""
    rows = lines(spark, path).where(F.size(F.split("value", ",")) == width + 1)
    out = _numbered(rows.select("ln", F.slice(numbers(F.col("value")), 1, width).alias("v")))
    if expected is not None and (n := out.count()) < expected:
        raise ValueError(f"{n} rows, {expected} expected")
    return out


def tower(spark: SparkSession, path: str, dims: int = 3) -> DataFrame:
    """One number a line, ``dims`` lines a point; blank lines don't count."""
    rows = lines(spark, path, "trim(value) <> ''")
    points = rows.groupBy(F.floor(F.col("ln") / dims).alias("id")).agg(F.sort_array(F.collect_list(F.struct("ln", F.trim("value").cast("double").alias("x")))).alias("s"))
    return points.where(F.size("s") == dims).select("id", F.col("s.x").alias("v"))


def bag_of_words(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(doc_id, word_id, cnt), (documents, words, cells): a three-line header, then triples."""
    rows = lines(spark, path)
    head = [int(r["value"].strip()) for r in rows.where("ln < 3").orderBy("ln").collect()]
    parts = F.split(F.trim("value"), r"\s+")
    cells = rows.where("ln >= 3").where(F.size(parts) == 3).select(*[parts[i].cast("long").alias(n) for i, n in enumerate(("doc_id", "word_id", "cnt"))])
    return cells, (head[0], head[1], head[2])


def coreset(spark: SparkSession, path: str) -> DataFrame:
    """id, w, v: a line with the number of rows, then ``w x1 .. xd``."""
    rows = lines(spark, path).where("ln > 0 and trim(value) <> ''").select("ln", numbers(F.col("value"), r"\s+").alias("x"))
    return rows.select((F.col("ln") - 1).alias("id"), F.col("x")[0].alias("w"), F.slice("x", 2, 1 << 30).alias("v"))


def centers(spark: SparkSession, path: str) -> DataFrame:
    """cid, v: plain rows of numbers separated by blanks."""
    rows = lines(spark, path).where("trim(value) <> ''").select("ln", numbers(F.col("value"), r"\s+").alias("v"))
    return rows.select(F.col("ln").alias("cid"), "v")


def weighted_centers(spark: SparkSession, path: str) -> DataFrame:
    """cid, v: rows with a leading weight."""
    return centers(spark, path).select("cid", F.slice("v", 2, 1 << 30).alias("v"))


def hard(spark: SparkSession, name: str) -> DataFrame:
    """A hard instance by the parameters in its name."""
    return hard_instance.rows(spark, *hard_instance.parse_name(name))


def _bow_points(spark: SparkSession, path: str) -> DataFrame:
    from coreloom.operators.sparse import cells_of, densify

    cells, (_, words, _) = bag_of_words(spark, path)
    return densify(cells_of(cells), words)


#: Parts of a path and their readers; the first part that the path holds decides.
REGISTRY = {"USCensus": census, "census": census, "covtype": covertype, "Tower": tower, "tower": tower, "docword": _bow_points, "benchmark": hard, ".csv": dense_csv, ".txt": dense_csv}


def points(spark: SparkSession, path: str) -> DataFrame:
    for part, reader in REGISTRY.items():
        if part in path:
            return reader(spark, path)
    raise ValueError(f"no reader for {path!r}")


def discover(spark: SparkSession, root: str, pattern: str = "results.txt.gz") -> DataFrame:
    """path of every file of the name below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of points (id, v): value and hour of the day. Rows with a
    null or non-finite coordinate are skipped."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern, so that a single file will do
    return rows.where("value is not null and ts is not null and not isnan(value)").select(F.col("event_id").alias("id"), F.array(F.col("value").cast("double"), F.hour("ts").cast("double")).alias("v"))


def text_stream(spark: SparkSession, folder: str, width: int, drop: str | None = None) -> DataFrame:
    """The comma-separated files of a folder as a stream of points (id, v) of ``width``
    coordinates. drop: "first" or "last" names one more attribute that is left out. Lines of
    another width, and headers, are skipped; ids are hashes of the lines."""
    parts = F.transform(F.split(F.trim("value"), ","), lambda x: F.trim(x))
    rows = spark.readStream.text(folder).select("value", parts.alias("parts"))
    rows = rows.where(F.size("parts") == width + (drop is not None)).withColumn("parts", F.slice("parts", 2 if drop == "first" else 1, width))
    rows = rows.where(F.forall("parts", lambda x: x.rlike(NUMBER)))
    return rows.select(F.xxhash64("value").alias("id"), F.col("parts").cast("array<double>").alias("v"))
