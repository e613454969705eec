"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Its anchor is the smallest hash
of the ``GRAM``-word grams in it, so equal windows have equal anchors, and consecutive
windows with one anchor form a *run*: some fifteen windows that travel as one row. A run is
known by the 128-bit cryptographic digest (d1, d2) of its words, joined by one space; the
anchor only proposes which runs may share windows.

The index is a folder: immutable tables of distinct runs, each row with the earliest
document that holds the run, bucketed and sorted by digest; the texts it was given; and a
manifest whose newest version names the live tables, so that a later session opens it and
goes on (``FingerprintIndex(spark, path)``).

* A batch of documents makes one table of runs, which is merge-joined, bucket by bucket and
  without a shuffle, with the tables of earlier batches: a run that an earlier document holds
  as a whole marks all its windows.
* Where one anchor has several distinct runs, in the batch or between it and the history, the
  windows of the earliest occurrence of each are verified one by one: by the digests of their
  words, read from the texts again. Of the history only texts that hold such a run are
  looked at; a bounded filter picks them. What is found, as places in the run, holds for all
  occurrences in the run's first document.
* After ``fan_in`` tables the index is compacted: tables are merged into one, the earliest
  document of each run stays, a new manifest is written, the old tables are deleted.

Documents reach the index in the order of their ids, batch by batch; only documents with a
mark are shuffled as texts, the others get their digest where they are read. A run in a
third of all documents is one row after the partial aggregation; joins on hot anchors are
plain equi-joins that adaptive execution splits.

Defined cases: null text has no words; a null doc_id counts as the largest; rows that share
a doc_id are judged alike and don't mark each other; an empty table gives an empty one;
other columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm.hashing import Words, digest128, mix64, sliding_min, text_chunks
from coreloom.llm.util import HashFilter, delete, dropped, exists, hashes_in, read_table, shared_dir, shuffle_partitions, written

WINDOW, GRAM = 50, 20
#: Batches of the query, and tables from which on the index is compacted.
BATCHES, FAN_IN = 3, 2
_LAST = (1 << 63) - 1


class Runs:
    """The runs of some texts: text, first window, number of windows, anchor of each."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.words = w = Words([b" ".join(t.split()) for t in texts])
        self.window = window
        grams, _ = w.windows(gram)
        n = len(w.hash) - window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            self.text, self.at, self.n, self.anchor = none, none, none, none.astype(np.uint64)
        else:
            least = sliding_min(grams, window - gram + 1)[:n]
            text = np.repeat(np.arange(len(texts)), np.diff(w.first))
            ok = text[:n] == text[window - 1 :]
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | ~ok[:-1]
            edges = np.flatnonzero(new | ~ok)
            ends = np.append(edges[1:], n)
            good = ok[edges]
            self.at, self.n = edges[good], (ends - edges)[good]
            self.text, self.anchor = text[self.at], least[self.at]
        self.start = self.at - w.first[self.text]

    def digests(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of the words from each place on."""
        raw, begin, end = self.words.data.tobytes(), self.words.start[at].tolist(), self.words.end[at + words - 1].tolist()
        return digest128(raw[a:z] for a, z in zip(begin, end))


_RUNS = "d1 long, d2 long, anchor long, doc long, rk long, start int, n int"


def _runs(window: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            for ids, texts in text_chunks(range(b.num_rows), b.column(2).cast(pa.binary()).to_pylist()):
                ids = np.array(ids)
                own = Runs(texts, window, gram)
                d = own.digests(own.at, own.n + window - 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "d1": pa.array(d[:, 0]),
                        "d2": pa.array(d[:, 1]),
                        "anchor": pa.array(own.anchor.view(np.int64)),
                        "doc": pa.array(doc[ids[own.text]]),
                        "rk": pa.array(rk[ids[own.text]]),
                        "start": pa.array(own.start.astype(np.int32)),
                        "n": pa.array(own.n.astype(np.int32)),
                    }
                )

    return go


def _occurrence(anchor: np.ndarray, rk: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(anchor ^ mix64(rk + start.astype(np.uint64)))


def _windows(window: int, gram: int, texts_in, shared):
    """The windows of the occurrences in the filter, each by the digest of its words; of rows
    outside the other filter nothing is looked at."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(hashes_in(texts_in.value, b.column(1).to_numpy())))
            doc, rk = b.column(0).to_numpy(), b.column(1).to_numpy()
            for ids, texts in text_chunks(range(b.num_rows), b.column(2).cast(pa.binary()).to_pylist()):
                ids = np.array(ids)
                own = Runs(texts, window, gram)
                keep = np.flatnonzero(hashes_in(shared.value, _occurrence(own.anchor, rk[ids[own.text]].view(np.uint64), own.start)))
                size = own.n[keep]
                row = np.repeat(keep, size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                w = own.digests(own.at[row] + place, np.full(len(row), window))
                run = own.digests(own.at[keep], size + window - 1)
                run = np.repeat(run, size, axis=0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "w1": pa.array(w[:, 0]),
                        "w2": pa.array(w[:, 1]),
                        "doc": pa.array(doc[ids[own.text[row]]]),
                        "d1": pa.array(run[:, 0]),
                        "d2": pa.array(run[:, 1]),
                        "place": pa.array(place.astype(np.int32)),
                    }
                )

    return go


def _occurrence_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        anchor, rk, start = (b.column(i).to_numpy() for i in range(3))
        yield pa.RecordBatch.from_pydict({"key": pa.array(_occurrence(anchor.view(np.uint64), rk.view(np.uint64), start).view(np.int64))})


def _with_anchor(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hashes_in(shared.value, b.column(2).to_numpy())))

    return go


class FingerprintIndex:
    """The index in the folder ``path``: opened if it is there, else new. ``tables`` are its
    live tables of runs, oldest first. ``source`` (doc, rk, text) may name a table that holds
    all that is ever ingested; otherwise the index keeps the texts itself."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN, source: DataFrame | None = None):
        self.source = source
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.path = path or f"{shared_dir(spark)}/coreloom-index-{uuid.uuid4().hex}"
        self.version, self.runs, self.texts = 0, [], []
        # a bucket is one sorted file, so that a merge join needs no sort either
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        if exists(spark, f"{self.path}/manifest"):
            every = spark.read.parquet(f"{self.path}/manifest")
            self.version = every.agg(F.max("version")).first()[0]
            for r in every.where(F.col("version") == self.version).orderBy("at").collect():  # a row a live table
                (self.runs if r["kind"] == "runs" else self.texts).append((r["file"], r["buckets"]))
        self.tables = [self._open(*x) for x in self.runs]

    def _open(self, file: str, buckets: int) -> DataFrame:
        name = f"coreloom_runs_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_RUNS}) USING parquet CLUSTERED BY (d1, d2) SORTED BY (d1, d2) INTO {buckets} BUCKETS LOCATION '{self.path}/{file}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        file, buckets = f"runs-{uuid.uuid4().hex}", shuffle_partitions(self.spark)
        name = f"coreloom_new_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, "d1", "d2").sortBy("d1", "d2").option("path", f"{self.path}/{file}").option("compression", "zstd").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # of the catalogue alone: the files are the index'
        return file, buckets

    def _commit(self) -> None:
        self.version += 1
        live = [("runs", *x) for x in self.runs] + [("texts", *x) for x in self.texts]
        rows = [(self.version, i, *x) for i, x in enumerate(live)]
        self.spark.createDataFrame(rows, "version long, at int, kind string, file string, buckets int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    @staticmethod
    def _earliest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc", "rk", "start", "n", "anchor")).alias("x"))
        return best.select("d1", "d2", "x.anchor", "x.doc", "x.rk", "x.start", "x.n")

    def ingest(self, rows: DataFrame) -> DataFrame:
        """rows: doc, rk, text (a batch of new documents) -> (doc, rk, start, n): the windows of
        the batch that start in an earlier document of the index or the batch."""
        occurrences = written(rows.mapInArrow(_runs(self.window, self.gram), _RUNS), "occurrences")
        added = self._write(self._earliest(occurrences))
        fresh = self._open(*added)
        kept = f"texts-{uuid.uuid4().hex}"
        if self.source is None:
            rows.write.option("compression", "zstd").parquet(f"{self.path}/{kept}")
        firsts = fresh.select("d1", "d2", "anchor", "doc", "rk", "start")
        known = None
        if self.tables:
            anchors = HashFilter(fresh, "anchor")
            for table in self.tables:
                own = table.select(F.col("d1").alias("t1"), F.col("d2").alias("t2"), F.struct("doc", "rk", "start").alias("old"))
                joined = firsts.join(own, (F.col("d1") == F.col("t1")) & (F.col("d2") == F.col("t2")), "left")
                least = F.least(F.struct("doc", "rk", "start"), F.col("old")).alias("x")
                firsts = joined.select("d1", "d2", "anchor", least).select("d1", "d2", "anchor", "x.*")
                near = table.join(fresh.select("d1", "d2"), ["d1", "d2"], "left_anti").select(*table.columns).mapInArrow(_with_anchor(anchors.shared), _RUNS)
                known = near if known is None else known.unionAll(near)
            known = written(self._earliest(known), "known")
            anchors.done()
        firsts = written(firsts, "firsts")
        merged = firsts if known is None else firsts.unionAll(known.select(*firsts.columns))
        whole = occurrences.join(firsts.select("d1", "d2", F.col("doc").alias("first")), ["d1", "d2"]).where("doc > first").select("doc", "rk", "start", "n")
        mixed = merged.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
        partial = written(merged.join(mixed, "anchor").select("anchor", "rk", "start"), "partial")
        wanted, texts_in = HashFilter(partial.mapInArrow(_occurrence_keys, "key long"), "key"), HashFilter(partial, "rk")
        held = rows if self.source is None else self.source
        for file, _ in self.texts:
            held = held.unionAll(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{file}"))
        windows = written(held.mapInArrow(_windows(self.window, self.gram, texts_in.shared, wanted.shared), "w1 long, w2 long, doc long, d1 long, d2 long, place int"), "windows")
        first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("w1", "w2", "first")
        places = windows.join(first, ["w1", "w2"]).where("doc > first").select("d1", "d2", "doc", "place").distinct()
        # a document may hold its run several times, or in several rows: each occurrence gets the run's places
        single = occurrences.select("d1", "d2", "doc", "rk", "start").join(places, ["d1", "d2", "doc"]).select("doc", "rk", (F.col("start") + F.col("place")).alias("start"), F.lit(1).alias("n"))
        found = written(whole.unionAll(single), "hits")  # before compaction deletes what they come from
        for x in (wanted, texts_in):
            x.done()
        for x in (occurrences, windows, firsts, partial, known):
            if x is not None:
                dropped(x)
        self.runs.append(added)
        self.tables.append(fresh)
        if self.source is None:
            self.texts.append((kept, 0))
        self._commit()
        self.compact()
        return found

    def compact(self) -> None:
        if len(self.tables) < self.fan_in:
            return
        rows = self.tables[0]
        for table in self.tables[1:]:
            rows = rows.unionAll(table)
        old, self.runs = self.runs, [self._write(self._earliest(rows))]
        self.tables = [self._open(*self.runs[0])]
        self._commit()
        for file, _ in old:
            delete(self.spark, f"{self.path}/{file}")


def _digests(window: int, marked: bool, shared=None):
    """Kept words of each text. marked: rows come with their windows; else only rows outside the filter count."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0)
            texts = b.column(2).cast(pa.binary()).to_pylist()
            if marked:
                use = np.arange(b.num_rows)
                spans = b.column(3).to_pylist()
            else:
                use = np.flatnonzero(~hashes_in(shared.value, b.column(1).to_numpy()))
                spans = None
            words, removed, sha, kept_text = [], [], [], []
            for i in use:
                own = texts[i].split()
                words.append(len(own))
                if spans and spans[i]:
                    cover = np.zeros(len(own) + 1, np.int64)
                    s = np.array([x["start"] for x in spans[i]])
                    e = np.minimum(s + np.array([x["n"] for x in spans[i]]) + window - 1, len(own))
                    np.add.at(cover, s, 1)
                    np.add.at(cover, e, -1)
                    keep = np.cumsum(cover)[:-1] == 0
                    own = [w for w, k in zip(own, keep) if k]
                removed.append(words[-1] - len(own))
                kept = b" ".join(own)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": doc.take(pa.array(use)), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string())}
            )

    return go


_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("rk"), "text", "doc_id")
    edges = rows.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("e")).first()["e"] or []
    index = FingerprintIndex(spark, None, window, gram, fan_in, source=rows.select("doc", "rk", "text"))
    marks = None
    for low, high in zip([None, *edges], [*edges, None]):  # in the order of ids, so the history is always earlier
        if low is not None and low == high:
            continue
        batch = rows.select("doc", "rk", "text")
        batch = batch if low is None else batch.where(F.col("doc") > low)
        batch = batch if high is None else batch.where(F.col("doc") <= high)
        found = index.ingest(batch)
        marks = found if marks is None else marks.unionAll(found)
    delete(spark, index.path)  # this index served one corpus; a lasting one has a path of its own
    marks = written(marks.distinct(), "marks")
    wanted = HashFilter(marks.select("rk").distinct(), "rk")
    fed = rows.select("doc_id", "rk", "text", "doc")
    clean = fed.mapInArrow(_digests(window, False, wanted.shared), _DIGEST)
    spans = marks.groupBy("doc", "rk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # at most a text's windows
    touched = fed.mapInArrow(_inside(wanted.shared), "doc_id long, rk long, text string, doc long")
    marked = touched.join(spans, ["doc", "rk"], "left").select("doc_id", "rk", "text", "spans").mapInArrow(_digests(window, True), _DIGEST)
    return clean.unionAll(marked)


def _inside(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hashes_in(shared.value, b.column(1).to_numpy())))

    return go


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
