"""Streaming summaries of clustering features.

Every micro-batch is compressed where it is read: each partition keeps at most ``m``
features (n, linear sum, squared sum), merging a point into the nearest one within the
current radius and doubling the radius when there are too many. The batch's features are
merged with the state in the same way. State is a table per batch id, so a batch that is
delivered twice replaces its own output and never counts twice.

Guaranteed: at most m features, and exact totals of n, sums and squared sums. Which points
share a feature depends on the order of arrival, as in any one-pass method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.operators.assign import matrix

SCHEMA = "n double, ls array<double>, ss double"


class FeatureSet:
    """At most m clustering features; insertion order decides the grouping."""

    def __init__(self, m: int):
        self.m, self.radius2 = m, 0.0
        self.n, self.ls, self.ss = np.zeros(0), None, np.zeros(0)

    def add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        if not len(n):
            return
        if self.ls is None:
            self.ls = np.zeros((0, ls.shape[1]))
        for a in range(0, len(n), 2 * self.m):
            self._block(n[a : a + 2 * self.m], ls[a : a + 2 * self.m], ss[a : a + 2 * self.m])

    def _block(self, n, ls, ss) -> None:
        self.n, self.ls, self.ss = np.append(self.n, n), np.vstack([self.ls, ls]), np.append(self.ss, ss)
        while len(self.n) > self.m:
            self._grow()
            self._merge()

    def _grow(self) -> None:
        c = self.ls / self.n[:, None]
        if not self.radius2:
            some = c[:256]
            d = ((some[:, None] - some[None]) ** 2).sum(2)
            d[np.diag_indices(len(d))] = np.inf
            positive = d[np.isfinite(d) & (d > 0)]
            self.radius2 = float(positive.min()) if len(positive) else 1e-300
        else:
            self.radius2 *= 4.0  # the radius doubles

    def _merge(self) -> None:
        c = self.ls / self.n[:, None]
        left, label, groups = np.arange(len(c)), np.zeros(len(c), np.int64), 0
        while len(left):
            near = ((c[left] - c[left[0]]) ** 2).sum(1) <= self.radius2
            label[left[near]] = groups
            groups += 1
            left = left[~near]
            if groups > 2 * self.m:  # far too many: the radius grows first
                label[left] = groups + np.arange(len(left))
                groups += len(left)
                break
        n, ss, ls = np.bincount(label, self.n, groups), np.bincount(label, self.ss, groups), np.zeros((groups, c.shape[1]))
        np.add.at(ls, label, self.ls)
        self.n, self.ls, self.ss = n, ls, ss

    def batch(self) -> pa.RecordBatch:
        ls = [] if self.ls is None else list(self.ls)
        return pa.RecordBatch.from_pydict({"n": pa.array(self.n), "ls": pa.array(ls, pa.list_(pa.float64())), "ss": pa.array(self.ss)})


def compress_points(points: DataFrame, m: int) -> DataFrame:
    """At most m features a partition. points: v, and w if they are weighted."""
    w = F.col("w").cast("double") if "w" in points.columns else F.lit(1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FeatureSet(m)
        for b in batches:
            if b.num_rows:
                x, n = matrix(b.column(0)), b.column(1).to_numpy()
                own.add(n, x * n[:, None], n * (x * x).sum(1))
        yield own.batch()

    return points.select(F.col("v").cast("array<double>").alias("v"), w.alias("w")).mapInArrow(run, SCHEMA)


def merge_features(features: DataFrame, m: int) -> DataFrame:
    """At most m features in all: partitions' features, m a partition, merged level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FeatureSet(m)
        for b in batches:
            if b.num_rows:
                own.add(b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy())
        yield own.batch()

    parts = features.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        features = features.coalesce(parts).mapInArrow(run, SCHEMA)
    return features.coalesce(1).mapInArrow(run, SCHEMA)


def summarize_stream(points: DataFrame, m: int, state_dir: str, checkpoint_dir: str):
    """Start a query that keeps ``state_dir/batch=<id>`` up to date; the last one is the summary."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = compress_points(batch, m)
        if batch_id > 0:
            fresh = fresh.unionByName(spark.read.schema(SCHEMA).parquet(f"{state_dir}/batch={batch_id - 1}"))
        merge_features(fresh, m).write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id}")

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def finish(query, spark, state_dir: str) -> DataFrame:
    """Wait for all that is there, then the features of the last batch."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    done = query.lastProgress
    last = done["batchId"] if done else None
    if last is None:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{state_dir}/batch={last}")


def as_coreset(features: DataFrame) -> DataFrame:
    """Weighted centroids (idx, is_center, w, v)."""
    v = F.transform("ls", lambda x: x / F.col("n"))
    return features.select(F.monotonically_increasing_id().alias("idx"), F.lit(True).alias("is_center"), F.col("n").alias("w"), v.alias("v"))


def summarize(points: DataFrame, m: int) -> DataFrame:
    """The same for a table: a coreset of at most m features."""
    return as_coreset(merge_features(compress_points(points, m), m))


def log_progress(spark, every: int = 10_000, write=print):
    """Register a listener that reports each ``every`` points of a stream; returns it."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        seen = told = 0

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            self.seen += event.progress.numInputRows
            if self.seen // every > self.told:
                self.told = self.seen // every
                write(f"{self.seen} points")

        def onQueryTerminated(self, event):
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
