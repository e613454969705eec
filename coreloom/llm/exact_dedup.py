"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every partition fingerprints its rows (first 8 bytes of SHA-256 of the text without
   the characters of ``[\\x20\\x09-\\x0D]``) and sends each owner, a range of the hash
   space, its sorted fingerprints as Golomb-Rice coded gaps.
2. Owners decode what they got, and answer each partition with a bitmap: which of its
   fingerprints occur more than once anywhere.
3. Only rows whose bit is set are suspects. Their normalised texts are shuffled and
   compared byte for byte: the text itself is the grouping key, with partial sums before
   the shuffle, so a group of copies that holds a third of all rows stays spread.

The scan's rows are written once, so partitions and ranks stay fixed if a task runs again.

Defined cases: null counts as empty; among equal texts the row with the most code points
stays, then the smallest doc_id (null last); repeated rows with one doc_id are all marked
kept if that id stays; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm.util import HashFilter, hashes_in, read_table, shuffle_partitions, written

#: Fingerprints that one owner compares.
OWNER_ROWS = 1_000_000
_GAPS = b" \t\n\x0b\x0c\r"


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted uint64 -> (parameter, unary quotients, packed remainders) of the gaps."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = int(max(0, np.log2(max(1.0, float(gaps.astype(np.float64).mean())))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    bits = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    bits[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(bits).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = gaps << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def normalised(text: bytes) -> bytes:
    return text.translate(None, _GAPS)


_SCAN = "part long, owner long, rank long, doc_id long, n_chars long, fp long, sha string, n long, k int, unary binary, rest binary"


def _scan(owners: int):
    width = (1 << 64) // owners + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, sizes, shas, fps = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            sizes += b.column(1).to_pylist()
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = hashlib.sha256(normalised(t))
                shas.append(h.hexdigest())
                fps.append(int.from_bytes(h.digest()[:8], "big"))
        if not ids:
            return
        fp = np.array(fps, np.uint64)
        order = np.argsort(fp, kind="stable")
        owner = (fp // np.uint64(width)).astype(np.int64)
        distinct, place = np.unique(fp, return_inverse=True)
        own = (distinct // np.uint64(width)).astype(np.int64)
        first = np.searchsorted(own, own)
        # a fingerprint that this partition holds twice is sent twice, so that its owner counts both
        counts = np.bincount(place)
        start = np.concatenate([[0], np.cumsum(counts)])
        rank = (start[:-1] - start[first])[place]
        n = len(ids)
        nulls = lambda kind: pa.nulls(n, kind)
        schema = pa.schema([("part", pa.int64()), ("owner", pa.int64()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fp", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part)), pa.array(owner), pa.array(rank), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fp.view(np.int64)), pa.array(shas), nulls(pa.int64()), nulls(pa.int32()), nulls(pa.binary()), nulls(pa.binary())],
            schema=schema,
        )
        ordered, by = fp[order], owner[order]
        cuts = np.flatnonzero(np.diff(by, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(by)]):
            low = np.uint64(int(by[a]) * width)
            k, unary, rest = rice_encode(ordered[a:z] - low)
            yield pa.RecordBatch.from_pylist([{"part": part, "owner": int(by[a]), "n": int(z - a), "k": k, "unary": unary, "rest": rest}], schema=schema)

    return run


def _answer(table: pa.Table) -> pa.Table:
    got = [rice_decode(r["n"], r["k"], r["unary"], r["rest"]) for r in table.select(["n", "k", "unary", "rest"]).to_pylist()]
    every, where, counts = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    bitmaps, at = [], 0
    for x in got:
        bitmaps.append(np.packbits(twice[at : at + len(x)]).tobytes())
        at += len(x)
    return pa.table({"part": table["part"], "owner": table["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def _suspect_texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normalised(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            digests = [hashlib.sha256(t) for t in texts]
            fp = np.array([int.from_bytes(h.digest()[:8], "big") for h in digests], np.uint64)
            keep = np.flatnonzero(hashes_in(shared.value, fp))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0).take(pa.array(keep)),
                    "n_chars": b.column(1).take(pa.array(keep)),
                    "sha": pa.array([digests[i].hexdigest() for i in keep], pa.string()),
                    "body": pa.array([texts[i] for i in keep], pa.binary()),
                }
            )

    return run


def exact_groups(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))
    owners = max(2, owners or max(shuffle_partitions(spark), docs.count() // OWNER_ROWS))
    scan = written(rows.mapInArrow(_scan(owners), _SCAN), "exact")
    own = scan.where("sha is not null").select("part", "owner", "rank", "doc_id", "n_chars", "fp", "sha")
    sent = scan.where("sha is null").select("part", "owner", "n", "k", "unary", "rest")
    bitmaps = sent.groupBy("owner").applyInArrow(_answer, "part long, owner long, bitmap binary")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("rank") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (7 - F.col("rank") % 8).cast("int")).bitwiseAND(F.lit(1))
    suspects = own.join(bitmaps, ["part", "owner"]).where(bit == 1).select("fp")
    wanted = HashFilter(suspects.distinct(), "fp")
    texts = rows.mapInArrow(_suspect_texts(wanted.shared), "doc_id long, n_chars long, sha string, body binary")
    best = F.max(F.struct("n_chars", F.bitwise_not(F.col("doc_id")).alias("inv")))
    groups = texts.groupBy("body").agg(F.count("*").alias("group_size"), best.alias("best"), F.first("sha").alias("sha"))
    groups = groups.where("group_size > 1").select("sha", "group_size", F.bitwise_not(F.col("best.inv")).alias("keep"))
    joined = own.select("doc_id", "sha").join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS size, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""
