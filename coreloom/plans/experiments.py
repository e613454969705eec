"""Experiment tables: grids, names, runs, and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("m", T.IntegerType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("randomSeed", T.LongType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("duration_secs", T.DoubleType()),
        T.StructField("process_id", T.IntegerType()),
    ]
)


def grid(datasets: DataFrame, algorithms: DataFrame, ks: DataFrame, iterations: int, multiple: int) -> DataFrame:
    """dataset, algorithm, k, iteration, m: every combination of small lists, m = multiple * k."""
    spark = datasets.sparkSession
    its = spark.range(1, iterations + 1).select(F.col("id").cast("int").alias("iteration"))
    rows = datasets.crossJoin(F.broadcast(algorithms)).crossJoin(F.broadcast(ks)).crossJoin(F.broadcast(its))
    return rows.withColumn("m", (F.col("k") * multiple).cast("int"))


def resolve(names: DataFrame, column: str, aliases: dict[str, str]) -> DataFrame:
    """The canonical name in place of an alias; an unknown name raises."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    found = F.try_element_at(table, F.lower(F.trim(F.col(column))))
    return names.withColumn(column, F.coalesce(found, F.raise_error(F.concat(F.lit("unknown name: "), F.col(column))).cast("string")))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records; absent keys get defaults."""
    rows = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    return rows.fillna({"iteration": -1, "randomSeed": -1, "k": -1, "m": -1, "duration_secs": -1.0, "process_id": -1})


def duration(runs: DataFrame) -> DataFrame:
    """Seconds from start_time to end_time (ISO text)."""
    return runs.withColumn("duration_secs", F.unix_micros(F.to_timestamp("end_time")) / 1e6 - F.unix_micros(F.to_timestamp("start_time")) / 1e6)


def unprocessed(runs: DataFrame, done: DataFrame, on: str = "name") -> DataFrame:
    return runs.join(done.select(on).distinct(), on, "left_anti")


def without_duplicates(queued: DataFrame, active: DataFrame, on: str = "name") -> tuple[DataFrame, DataFrame]:
    """(to run, discarded because a run of the name is active or done)."""
    names = active.select(on).distinct()
    return queued.join(names, on, "left_anti"), queued.join(names, on, "left_semi")


def first_per_configuration(runs: DataFrame, config: list[str], order: str) -> DataFrame:
    return runs.withColumn("_r", F.row_number().over(W.partitionBy(*config).orderBy(order))).where("_r = 1").drop("_r")


def next_run(ready: DataFrame, name: str = "name") -> DataFrame:
    """The lowest name first."""
    return ready.orderBy(name).limit(1)


def states(runs: DataFrame, started: DataFrame, finished: DataFrame, on: str = "name") -> DataFrame:
    """runs with status ready, in-progress, completed or discarded (a later run of a name that is taken)."""
    first = F.row_number().over(W.partitionBy(on).orderBy("queued_at", "run_id"))
    s, f = started.select(on, F.lit(True).alias("_s")).distinct(), finished.select(on, F.lit(True).alias("_f")).distinct()
    rows = runs.withColumn("_r", first).join(s, on, "left").join(f, on, "left")
    status = F.when(F.col("_r") > 1, "discarded").when(F.col("_f"), "completed").when(F.col("_s"), "in-progress").otherwise("ready")
    return rows.withColumn("status", status).drop("_r", "_s", "_f")


def check_size(rows: DataFrame, least: int) -> int:
    """The number of rows; fewer than expected is a warning."""
    import warnings

    n = rows.count()
    if n < least:
        warnings.warn(f"{n} rows, at least {least} expected", stacklevel=2)
    return n
