"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

1. The tree is fitted on at most ``sample_rows`` vectors (the first by a hash of the id);
   every row is then sent down to its leaf, so the index holds all rows. The tree is what
   is broadcast; its size follows from ``sample_rows``.
2. A query opens nodes from a priority queue, nearest centre first, until it has visited
   enough leaves. How many are enough is calibrated: for ``probe_queries`` queries the true
   neighbours are found by brute force over all rows, and the visits are widened until the
   leaves hold at least ``recall`` of them. A query goes on beyond that until its leaves
   hold more than k rows.
3. Leaves meet their queries in blocks: rows of a large leaf are dealt to parts, queries of
   a much visited leaf to others; each block answers with k rows a query, and the k nearest
   of all blocks stay. Of equal vectors in a block the k + 1 smallest ids suffice.

Distances are Euclidean, in double precision, from the original components; ties go to the
smaller vec_id. Brute force runs in blocks of the stated queries against all rows.

Defined cases: vectors that are null or zero or hold a null or non-finite component take no
part; rows without vec_id neither; vectors of another length than the query's have no distance
to it, so each length is searched by itself; rows with the query's id are never its neighbours; repeated rows (one id and vector) count once, and a query id
with several vectors asks with the smallest; with fewer than k candidates all are returned; an empty table
gives an empty one; other columns are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.llm.util import read_table, written

ROWS_A_PART, QUERIES_A_PART = 20_000, 2_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        found = np.unique(near)
        new = np.stack([x[near == c].mean(0) for c in found])
        if len(new) == len(centres) and np.allclose(new, centres):
            break
        centres = new
    return centres


class Tree:
    """children[i] are the nodes below node i (none: a leaf); centres[i] its centre."""

    def __init__(self, sample: np.ndarray, branch: int = 16, leaf_rows: int = 100, seed: int = 5):
        self.centres, self.children, self.leaf = [sample.mean(0)], [[]], [-1]
        rng = np.random.default_rng(seed)
        todo, self.leaves = [(0, sample)], 0
        while todo:
            node, own = todo.pop()
            centres = _kmeans(own, min(branch, len(own)), rng) if len(own) > leaf_rows else own[:1]
            if len(centres) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            near = self._nearest(own, centres)
            for c in range(len(centres)):
                if (near == c).any():
                    self.children[node].append(len(self.centres))
                    todo.append((len(self.centres), own[near == c]))
                    self.centres.append(centres[c])
                    self.children.append([])
                    self.leaf.append(-1)
        self.centres = np.stack(self.centres)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = self._nearest(x[rows], self.centres[self.children[node]])
                todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
            else:
                below = self.children[node]
                for d, c in zip(((self.centres[below] - q) ** 2).sum(1), below):
                    heapq.heappush(queue, (float(d), c))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest_in(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query its k nearest rows (query place, vec_id, distance); exact, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)
    # of equal vectors only the first k + 1 ids can be among the k nearest of any query
    _, same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    by = by[np.append(True, (np.diff(same[by]) != 0) | (np.diff(ids[by]) != 0))]  # a repeated row counts once
    start = np.flatnonzero(np.diff(same[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    keep = np.sort(by[place <= k])
    ids, x = ids[keep], x[keep]
    norms = (x * x).sum(1)
    out_q, out_id, out_d = [], [], []
    for block in range(0, len(q), 256):
        some = q[block : block + 256]
        rough = norms - 2 * some @ x.T + (some * some).sum(1)[:, None]
        for i, (row, own) in enumerate(zip(rough, some)):
            others = np.flatnonzero(ids != q_ids[block + i])
            row = row[others]
            edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            near = others[row <= edge + 1e-9 * (1 + abs(edge) + norms.max())]
            d = np.sqrt(((x[near] - own) ** 2).sum(1))
            best = np.lexsort((ids[near], d))[:k]
            out_q.append(np.full(len(best), block + i))
            out_id.append(ids[near[best]])
            out_d.append(d[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.assign(_matrix(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    return run


def _brute(shared, k: int):
    """The k nearest rows of a partition for each query of a bounded set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            if b.num_rows:
                ids, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                at, found, d = nearest_in(ids, _matrix(b.column(1)), q_ids, q, k)
                leaves = dict(zip(ids.tolist(), leaf.tolist()))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[at]), "vec_id": pa.array(found), "leaf": pa.array([leaves[i] for i in found.tolist()], pa.int64()), "score": pa.array(d)})

    return run


def _visits(shared, least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for b in batches:
            places, leaves = [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else ()):
                held = 0
                for n, leaf in enumerate(tree.visit(q)):
                    if n >= least and held > k:
                        break
                    held += int(sizes[leaf])
                    if sizes[leaf]:
                        places.append(i)
                        leaves.append(leaf)
            take = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(leaves, pa.int64())], names=["query_id", "q", "leaf"])

    return run


def _block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, x = queries.combine_chunks(), rows.combine_chunks()
        if not q.num_rows or not x.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "score": pa.array([], pa.float64())})
        q_ids = q["query_id"].to_numpy()
        at, found, d = nearest_in(x["vec_id"].to_numpy(), _matrix(x["v"].combine_chunks()), q_ids, _matrix(q["q"].combine_chunks()), k)
        return pa.table({"query_id": q_ids[at], "vec_id": found, "score": d})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double>: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows


def search(vectors: DataFrame, is_query, k: int = 10, recall: float = 0.95, sample_rows: int = 10_000, probe_queries: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id."""
    rows = usable(vectors)
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # one, but for mixed tables
    found = None
    for n in lengths or [0]:
        own = _search(rows.where(F.size("v") == n), is_query, k, recall, sample_rows, probe_queries)
        found = own if found is None else found.unionAll(own)
    return found


def _search(rows: DataFrame, is_query, k: int, recall: float, sample_rows: int, probe_queries: int) -> DataFrame:
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow().combine_chunks()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_matrix(chosen["v"].combine_chunks()))
    placed = written(rows.mapInArrow(_assign(spark.sparkContext.broadcast(tree)), "vec_id long, v array<double>, leaf long"), "leaves")
    queries = placed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row a leaf
        sizes[r["leaf"]] = r["count"]
    probe = queries.orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(probe_queries).toArrow().combine_chunks()
    if not probe.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probe_q = _matrix(probe["q"].combine_chunks())
    shared = spark.sparkContext.broadcast((probe["query_id"].to_numpy(), probe_q))
    near = placed.mapInArrow(_brute(shared, k), "query_id long, vec_id long, leaf long, score double")
    first = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    truth = near.withColumn("r", first).where(F.col("r") <= k).select("query_id", "leaf").toPandas()  # k rows a probe query
    least = _calibrated(tree, dict(zip(probe["query_id"].to_pylist(), probe_q)), truth, recall)
    visits = written(queries.mapInArrow(_visits(spark.sparkContext.broadcast((tree, sizes)), least, k), "query_id long, q array<double>, leaf long"), "visits")
    parts = visits.groupBy("leaf").agg(F.count("*").alias("nq"))
    parts = parts.join(placed.groupBy("leaf").agg(F.count("*").alias("nx")), "leaf").select("leaf", F.ceil(F.col("nx") / ROWS_A_PART).alias("px"), F.ceil(F.col("nq") / QUERIES_A_PART).alias("pq"))
    parts = F.broadcast(parts)  # a row a leaf; the tree's sample bounds their number
    q_side = visits.join(parts, "leaf").select("leaf", "query_id", "q", F.pmod(F.xxhash64("query_id"), "pq").alias("bq"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("px") - 1)).alias("bx"))
    x_side = placed.join(parts, "leaf").select("leaf", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), "px").alias("bx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pq") - 1)).alias("bq"))
    found = q_side.groupBy("leaf", "bq", "bx").cogroup(x_side.groupBy("leaf", "bq", "bx")).applyInArrow(_block(k), "query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(tree: Tree, probe: dict, truth, recall: float) -> int:
    """Leaf visits that reach the recall on the probe queries."""
    need = []
    for query_id, own in truth.groupby("query_id"):
        place = {leaf: i for i, leaf in enumerate(tree.visit(probe[query_id]))}
        need += [place[x] + 1 for x in own["leaf"]]
    need = np.sort(need)
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else tree.leaves


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
