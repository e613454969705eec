"""Near-duplicate documents by BagMinHash over multisets of word shingles.

1. A text's multiset of ``SHINGLE``-word shingles (unchanged words ``[^\\x20\\x09-\\x0D]+``;
   a shorter text is one shingle) is a weight for each shingle. Weights are discretised:
   the weight axis is split into the dyadic intervals [0,1), [1,2), [2,4), ... and each
   shingle and interval is the seed of one Poisson process over time, signature component
   and unit cell of the interval. A point counts if its cell lies below the weight. The
   first counting point of each component is its signature, so two components are equal
   with probability sum(min) / sum(max), the weighted Jaccard similarity. The dyadic intervals
   are the levels of the hierarchy: those above a weight are never looked at, a point of the
   level that a weight cuts counts by its cell, and times beyond the last component's are not
   generated.
2. Texts with the same words (by a 128-bit cryptographic digest) collapse to the smallest doc_id. Signatures are banded; in a
   bucket every document is paired with the smallest one alone (a star, not all pairs).
3. Pairs are verified on the true multisets, in groups of one leader and at most about
   ``GROUP`` of its documents. A document that is unlike its leader is compared with all
   others of the star, block by block, so no link of a bucket is lost; overlaps come from
   matrix products and only links that join two parts are given out. Of n documents of a star
   with u below the threshold this gives out n * (u / ``GROUP`` + 1) rows, none where u is 0.
4. Verified pairs are joined to classes by star contraction.

Similar: sum(min) / sum(max) >= 0.8. The smallest doc_id of a class is its id and stays.

Defined cases: a text without words (null, empty) is a class of its own; rows with a null
doc_id are classes of their own with a null id and stay; rows that share a doc_id are one
document, of which one row stays; an empty table gives an empty one; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coreloom.llm.hashing import Words, digest128, mix64, text_chunks, window_hashes
from coreloom.llm.util import HashFilter, dropped, hashes_in, read_table, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
#: Documents that are compared with one leader in one group.
GROUP = 1000

_U = np.uint64


def multisets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of all texts, by text and then shingle."""
    w = Words(texts)
    counts = np.diff(w.first)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + w.first[text]
    shingle = np.zeros(len(text), _U)
    for k in range(1, n + 1):  # a shorter text is one shingle
        own = np.minimum(counts, n)[text] == k
        if own.any():
            shingle[own] = window_hashes(w.hash, k)[at[own]] ^ mix64(np.array([k], _U))[0]
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """BagMinHash signatures, (texts, m) uint64; rows of texts without shingles are 0."""
    total = np.bincount(text, weight, minlength=texts)
    limit = (np.log(m) + 4) / np.maximum(total, 1)
    times, ids = np.full(texts * m, np.inf), np.zeros(texts * m, _U)
    # one process for each shingle and each dyadic interval that its weight reaches
    parts = [(np.arange(len(text)), 0, 1)]
    low = 1
    while len(weight) and low < weight.max():
        parts.append((np.flatnonzero(weight > low), low, low))
        low *= 2
    row = np.concatenate([p[0] for p in parts])
    start = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    length = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    seed = mix64(shingle[row] ^ mix64(start.astype(_U) + _U(0x51ED27)))
    owner, reach = text[row], weight[row] - start
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pending = np.zeros(texts, bool)
        pending[todo] = True
        live = np.flatnonzero(pending[owner])
        clock, state = np.zeros(len(live)), seed[live]
        flat_all, time_all, id_all = [], [], []
        while len(live):
            state = mix64(state + _U(0x9E3779B97F4A7C15))
            u = ((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            clock = clock - np.log(u) / (m * length[live])
            on = clock < limit[owner[live]]
            live, clock, state = live[on], clock[on], state[on]
            draw = mix64(state ^ _U(0xA5A5A5A5A5A5A5A5))
            component = ((draw >> _U(32)) * _U(m)) >> _U(32)
            cell = ((draw & _U(0xFFFFFFFF)) * length[live].astype(_U)) >> _U(32)
            hit = cell.astype(np.int64) < reach[live]
            flat_all.append(owner[live[hit]] * m + component[hit].astype(np.int64))
            time_all.append(clock[hit])
            id_all.append(draw[hit])
        flat, when, what = np.concatenate(flat_all), np.concatenate(time_all), np.concatenate(id_all)
        np.minimum.at(times, flat, when)
        won = times[flat] == when
        ids[flat[won]] = what[won]
        open_ = np.isinf(times.reshape(texts, m)).any(axis=1) & pending
        limit[open_] *= 2  # the same points come again, and later ones
        todo = np.flatnonzero(open_)
    return ids.reshape(texts, m)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=_U)), (len(signature), bands))
    for k in range(rows):
        h = mix64(h * _U(0xD6E8FEB86659FD93) + signature[:, k::rows][:, :bands])
    return h


def _scan(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in text_chunks(range(b.num_rows), b.column(1).cast(pa.binary()).to_pylist()):
                text, shingle, weight = multisets(texts, n)
                sig = signatures(text, shingle, weight, len(texts), bands * rows)
                filled = np.bincount(text, minlength=len(texts)) > 0
                h = bands_of(sig, bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))]).astype(np.int32)
                same = digest128(b" ".join(t.split()) for t in texts)  # texts with the same words
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": b.column(0).take(pa.array(ids)),
                        "row": b.column(2).take(pa.array(ids)),
                        "h1": pa.array(same[:, 0]),
                        "h2": pa.array(same[:, 1]),
                        "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[filled].ravel().view(np.int64))),
                    }
                )

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """sum(min) of two multisets (sorted shingles, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0]
    return int(np.minimum(a[1][at[same]], b[1][same]).sum())


def similar(a, b, least: float) -> bool:
    na, nb = int(a[1].sum()), int(b[1].sum())
    if min(na, nb) < least * max(na, nb):
        return False
    both = overlap(a, b)
    return both >= least * (na + nb - both)


def overlaps(bags: list, rows: list[int]) -> np.ndarray:
    """sum(min) of some of the multisets with all, as a product of 0/1 matrices: a shingle of
    weight w is w features, and only those that two multisets hold count."""
    shingle = np.concatenate([np.repeat(x[0], x[1]) for x in bags])
    level = np.concatenate([np.arange(x[1].sum()) - np.repeat(np.cumsum(x[1]) - x[1], x[1]) for x in bags])
    owner = np.repeat(np.arange(len(bags)), [int(x[1].sum()) for x in bags])
    _, feature, counts = np.unique(mix64(shingle ^ mix64(level.astype(_U))), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[feature] > 1
    owner, feature = owner[shared], column[feature[shared]]
    total = int((counts > 1).sum())
    out, width = np.zeros((len(rows), len(bags))), max(1, min(total, 8_000_000 // len(bags)))
    for low in range(0, total, width):
        on = (feature >= low) & (feature < low + width)
        cells = np.zeros((len(bags), width), np.float32)
        cells[owner[on], feature[on] - low] = 1
        out += cells[rows] @ cells.T
    return out


class Forest:
    """Keeps the links that join two parts; the others add nothing to the classes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _near(rows: list, asked: list[int], least: float, forest: Forest) -> Iterator[tuple[int, int]]:
    """The links of some of the rows (doc, multiset) with all, as a forest."""
    bags = [x[1] for x in rows]
    total = np.array([x[1].sum() for x in bags], np.float64)
    both = overlaps(bags, asked)
    near = both >= least * (total[asked][:, None] + total[None, :] - both)
    for i, j in zip(*np.nonzero(near)):
        a, b = rows[asked[i]][0], rows[j][0]
        if forest.join(a, b):
            yield a, b


def _verify(n: int, least: float):
    """Rows (leader, i, j, doc, role, text), a group's rows together, the leader first.

    j < 0: one leader (role 0) and documents of its star (role 1): links with the leader, a
    row (leader, doc, failed true) for each that is unlike it, and, where the star is one
    group (j = -1), the links of these with the others of the group.
    j >= 0: documents unlike their leader (role 0) against a block of its star (role 1)."""

    def flush(key: tuple, group: list, out: list) -> None:
        forest = Forest()
        if key[2] >= 0:
            rows = [x[1:] for x in group]
            asked = [k for k, x in enumerate(group) if x[0] == 0]
            out += [(*x, False) for x in _near(rows, asked, least, forest)] if asked and len(rows) > 1 else []
            return
        leader, rest = group[0][1:], [x[1:] for x in group[1:]]
        unlike = []
        for k, (doc, bag) in enumerate(rest):
            if similar(leader[1], bag, least):
                forest.join(leader[0], doc)
                out.append((leader[0], doc, False))
            else:
                unlike.append(k)
                if key[2] == -2:
                    out.append((leader[0], doc, True))
        if unlike and len(rest) > 1 and key[2] == -1:
            out += [(*x, False) for x in _near(rest, unlike, least, forest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []

        def made() -> pa.RecordBatch:
            a, b, failed = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "failed": pa.array(failed, pa.bool_())})

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            docs, roles = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            texts = batch.column(5).cast(pa.binary()).to_pylist()
            at = 0
            for _, own in text_chunks(range(len(texts)), texts):
                text, shingle, weight = multisets(own, n)
                cut = np.searchsorted(text, np.arange(len(own) + 1))
                for i in range(len(own)):
                    if keys[at] != key:
                        if group:
                            flush(key, group, out)
                        key, group = keys[at], []
                    s = slice(cut[i], cut[i + 1])
                    group.append((roles[at], docs[at], (shingle[s], weight[s])))
                    at += 1
            if len(out) > 50_000:
                yield made()
        if group:
            flush(key, group, out)
        yield made()

    return run


def _wanted_texts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hashes_in(shared.value, mix64(b.column(0).to_numpy().view(_U)))))

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"key": pa.array(mix64(b.column(0).to_numpy().view(_U)).view(np.int64))})


def _stars(bands: DataFrame) -> DataFrame:
    """bands: doc, band -> distinct (leader, doc); the leader is a bucket's smallest document."""
    buckets = bands.groupBy("band").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader < last").select("band", "leader")
    return bands.join(buckets, "band").where("doc > leader").select("leader", "doc").distinct()


def similar_pairs(bands: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """bands: doc, band; texts: doc, text -> verified (a, b), enough to join what is similar."""
    star = written(_stars(bands), "stars")
    sizes = star.groupBy("leader").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / GROUP)
    block = F.pmod(F.xxhash64("doc"), "blocks")
    parted = written(star.join(sizes, "leader").select("leader", "doc", blocks.alias("blocks")).withColumn("block", block), "blocks")
    ids = parted.select("doc").unionAll(parted.select("leader")).distinct().mapInArrow(_mixed, "key long")
    near = texts.mapInArrow(_wanted_texts(HashFilter(ids, "key").shared), "doc long, text string")
    near = written(near.groupBy("doc").agg(F.max("text").alias("text")), "star-texts")

    def verified(rows: DataFrame) -> DataFrame:
        fed = rows.join(near, "doc").select("leader", "i", "j", "doc", "role", "text")
        fed = fed.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "role", "doc")
        return written(fed.mapInArrow(_verify(n, least), "a long, b long, failed boolean"), "verified")

    kind = F.when(F.col("blocks") > 1, -2).otherwise(-1).cast("long").alias("j")
    first = parted.select("leader", F.col("block").alias("i"), kind, "doc", F.lit(1).alias("role"))
    first = first.unionAll(parted.select("leader", F.col("block").alias("i"), kind, F.col("leader").alias("doc"), F.lit(0).alias("role")).distinct())
    found = verified(first)
    pairs = found.where("not failed").select("a", "b")
    # in stars of several groups, those unlike their leader, dealt to blocks of their own, meet
    # all others block by block; a star without such documents gives nothing out here
    unlike = written(found.where("failed").select(F.col("a").alias("leader"), F.col("b").alias("doc")), "unlike")
    rows = unlike.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    asked = parted.join(unlike, ["leader", "doc"]).join(rows, "leader")
    asked = asked.select("leader", F.pmod(F.xxhash64("doc"), "parts").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "doc", F.lit(0).alias("role"))
    others = parted.where("blocks > 1").join(rows, "leader")
    others = others.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), "doc", F.lit(1).alias("role"))
    return pairs.unionAll(verified(asked.unionAll(others)).select("a", "b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> (doc, class): the smallest member of each connected component.

    Alternating large and small stars; every step is an aggregation and a join."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        out = moved.where("v > u") if large else moved
        out = out.select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = out.unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a < b").distinct()

    now = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    mark = None
    while True:
        new = written(star(star(now, True), False), "edges")
        seen = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        dropped(now)
        now = new
        if seen == mark:
            return now.select(F.col("b").alias("doc"), F.col("a").alias("class"))
        mark = seen


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, row_key: str | None = None) -> DataFrame:
    """doc_id, class_id (the class' smallest doc_id), kept: a row for each row of ``docs``; with
    ``row_key``, a column of longs, also that, and of rows that share an id only one is kept."""
    key = F.col(row_key) if row_key else F.monotonically_increasing_id()
    own = docs.select(key.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with_id = own.where("doc is not null").select("doc", "text")
    scan = written(own.select("doc", "text", "row").mapInArrow(_scan(shingle, bands, rows), "doc long, row long, h1 long, h2 long, bands array<long>"), "minhash")
    some = scan.where("doc is not null and size(bands) > 0")
    groups = written(some.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "words")
    reps = groups.select(F.col("rep").alias("doc"), "h1", "h2").join(some, ["doc", "h1", "h2"]).select("doc", F.explode("bands").alias("band")).distinct()
    banded = written(reps, "bands")
    pairs = similar_pairs(banded, with_id, shingle, least)
    # rows with the same words, or the same id, belong together too
    same = some.join(groups.where("n > 1"), ["h1", "h2"]).where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    classes = components(pairs.unionAll(same))
    # of the rows of an id that stays, the first by the digest of its words and its key
    first = scan.where("doc is not null").groupBy("doc").agg(F.min(F.struct("h1", "h2", "row")).alias("first"))
    known = first.join(classes, "doc", "left").select(F.col("doc").alias("known"), F.coalesce("class", "doc").alias("class_id"), F.col("first.row").alias("first"))
    out = scan.select("row", "doc").join(known, F.col("doc") == F.col("known"), "left")
    kept = F.col("doc").isNull() | ((F.col("doc") == F.col("class_id")) & (F.col("row") == F.col("first")))
    named = [F.col("row").alias(row_key)] if row_key else []
    return out.select(*named, F.col("doc").alias("doc_id"), "class_id", kept.alias("kept"))


def kept_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` that stay: one row of each class, and all without an id."""
    own = docs.select(F.monotonically_increasing_id().alias("near_row"), F.struct(*docs.columns).alias("near_all"))
    own = written(own, "near-rows")  # with its keys, so that they are the same in both reads
    gone = near_duplicates(own.select("near_row", "near_all.doc_id", "near_all.text"), row_key="near_row", **how).where("not kept")
    return own.join(gone.select("near_row"), "near_row", "left_anti").select("near_all.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
