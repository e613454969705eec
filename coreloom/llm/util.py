"""Shared pieces of the training-data operators: tables written to the shared
folder, a bounded membership filter."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter (8 MB), and of one that is sized by its keys at most (32 MB).
FILTER_BITS, MAX_FILTER_BITS = 1 << 26, 1 << 28


#: Rows of an Arrow batch at most: with long texts the default of 10,000 is too much memory.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    # Spark 4.1 takes a union of tables of one bucketing for bucketed, though rows of one key
    # are in several of its partitions: a grouping on top of it then gives a key several rows
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only a local session that
    names none, as in tests, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = sc_dir.get() if sc_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.delete(target, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_sweep)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Unlike ``checkpoint()``, which computes its input twice, this runs it once; the
    rows are fixed from then on and survive the loss of any executor."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/coreloom-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._coreloom_path = path
    return out


def bucketed(df: DataFrame, what: str, column: str) -> DataFrame:
    """``written`` with the rows dealt to buckets of ``column`` where they are made: joins on
    it move the other side alone."""
    spark = df.sparkSession
    bounded_batches(spark)
    path, name = f"{shared_dir(spark)}/coreloom-{what}-{uuid.uuid4().hex}", f"coreloom_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), column).option("path", path).option("compression", "zstd").saveAsTable(name)
    _written.append((spark, path))
    return spark.table(name)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing will read it again."""
    path = getattr(df, "_coreloom_path", None)
    if path:
        delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Words of eight bytes that one row of a membership filter carries on its way to the driver.
_SLICE = 1 << 13


def _slice_blob(key: tuple, table: pa.Table) -> pa.Table:
    filled = np.zeros(_SLICE, np.int64)
    filled[table["word"].to_numpy() & (_SLICE - 1)] = table["mask"].to_numpy()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([filled.tobytes()], pa.binary())})


class HashFilter:
    """Membership filter (a Bloom filter of two probes) for 64-bit hashes. No false
    negatives; false positives only cost work, as an exact step always follows. It keeps
    most rows that cannot matter out of a shuffle. Its size is bounded: ``FILTER_BITS``, or
    about sixteen bits for each of ``expected`` keys, up to ``MAX_FILTER_BITS``. The driver
    gets no more than these bits, in slices that tasks have put together."""

    def __init__(self, keys: DataFrame, column: str, expected: int | None = None):
        bits = FILTER_BITS if expected is None else min(MAX_FILTER_BITS, 1 << max(20, (16 * expected - 1).bit_length()))
        mask = F.lit(bits - 1).cast("long")
        slots = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
        table = keys.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
        parts = table.groupBy(F.floor(F.col("word") / _SLICE).alias("part")).applyInArrow(_slice_blob, "part long, blob binary").toArrow()
        filled = bytearray(bits // 8)
        for part, blob in zip(parts["part"].to_pylist(), parts["blob"].to_pylist()):
            filled[part * _SLICE * 8 : (part + 1) * _SLICE * 8] = blob
        self.shared = keys.sparkSession.sparkContext.broadcast(bytes(filled))

    def done(self) -> None:
        """Free the executors' copies; one that is needed again is fetched again."""
        self.shared.unpersist()


def hashes_in(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the bytes of a HashFilter hold; its size follows from their length."""
    filled, mask = np.frombuffer(raw, np.uint64), np.uint64(len(raw) * 8 - 1)
    hashes = hashes.astype(np.uint64)
    at = np.arange(len(hashes))
    for shift in (0, 32):  # the second bit is looked up for those alone that have the first
        slots = (hashes[at] >> np.uint64(shift)) & mask
        at = at[(filled[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0]
    found = np.zeros(len(hashes), bool)
    found[at] = True
    return found
