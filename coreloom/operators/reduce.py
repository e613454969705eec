"""Dimension reduction: SVD and PCA from the Gram matrix, and random sketches.

The Gram matrix (d x d, d at most ``MAX_DIM``) is the only thing that reaches the driver;
rows are projected in a map. Wider data go through a sketch first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coreloom.functions import rng
from coreloom.operators.aggregates import gram
from coreloom.operators.assign import matrix

MAX_DIM = 4000


def gram_matrix(points: DataFrame) -> np.ndarray:
    width = points.select(F.max(F.size("v"))).first()[0] or 0
    if width > MAX_DIM:
        raise ValueError(f"{width} dimensions: sketch to at most {MAX_DIM} first")
    table = gram(points).toArrow()
    out = np.zeros((width, width))
    i, j, x = table["i"].to_numpy(), table["j"].to_numpy(), table["val"].to_numpy()
    out[i, j] = x
    out[j, i] = x
    return out


def _spectrum(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, eigenvectors as columns, largest entry of each positive."""
    values, vectors = np.linalg.eigh(g)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    top = np.abs(vectors).argmax(0)
    return values, vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1.0, 1.0)


def _times(points: DataFrame, m: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((m, shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shift = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                y = (x if shift is None else x - shift) @ m
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "v"])

    return points.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>")


def truncated_svd(points: DataFrame, rank: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rank-r reconstruction of the same shape, V (d x r), singular values)."""
    values, vectors = _spectrum(gram_matrix(points))
    v = vectors[:, :rank]
    return _times(points, v @ v.T), v, np.sqrt(values)


def project_svd(points: DataFrame, rank: int) -> tuple[DataFrame, np.ndarray]:
    """(X V: n x r with fixed signs, V)."""
    _, vectors = _spectrum(gram_matrix(points))
    v = vectors[:, :rank]
    return _times(points, v), v


def lift(centers: DataFrame, v: np.ndarray) -> DataFrame:
    """Centres of the reduced space back in the original one: C V'."""
    return _times(centers.select(F.col("cid").alias("id"), "v"), v.T).withColumnRenamed("id", "cid")


def pca(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as columns, variances)."""
    n = points.count()
    means = points.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x")).orderBy("pos").collect()
    mean = np.array([r["x"] for r in means])
    values, vectors = _spectrum((gram_matrix(points) - n * np.outer(mean, mean)) / max(1, n - 1))
    return mean, vectors, values


def explained_variance(points: DataFrame) -> DataFrame:
    """component, variance, ratio, cumulative"""
    _, _, values = pca(points)
    ratio = values / values.sum() if values.sum() else values
    rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(values, ratio, np.cumsum(ratio)))]
    return points.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


# Sketches of cells(row, col, val): S x A with S of ``size`` rows.

_WORD = "18446744073709551616"  # 2^64


def _odd(seed, tag: str) -> int:
    import hashlib

    return int(hashlib.md5(f"{seed}:{tag}".encode()).hexdigest()[:15], 16) | 1


def bucket_hash(row: F.Column, bits: int, seed) -> F.Column:
    """Multiply-shift hash of a non-negative long to [0, 2^bits): top bits of (a x + b) mod 2^64."""
    a, b = _odd(seed, "a"), _odd(seed, "b")
    x = (row.cast("decimal(19,0)") * F.lit(str(a)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(str(b)).cast("decimal(38,0)")
    low = x.cast("decimal(38,0)") % F.lit(_WORD).cast("decimal(20,0)")
    return F.call_function("div", low, F.lit(str(1 << (64 - bits))).cast("decimal(20,0)"))  # / rounds to six places, up to the next bucket


def bucket_hash_sql(row: str, bits: int, seed) -> str:
    a, b = _odd(seed, "a"), _odd(seed, "b")
    return f"((({row})::HUGEINT * {a}::HUGEINT + {b}::HUGEINT) % {_WORD}::HUGEINT // {1 << (64 - bits)}::HUGEINT)::BIGINT"


def _mask(seed, tag: str) -> int:
    return _odd(seed, tag) & 0x7FFFFFFF


def sign(i: F.Column, s1: F.Column, s3: F.Column, s0: F.Column) -> F.Column:
    """4-wise independent +-1: parity of s0, s1 & i and s3 & i^3 (modulo 2^31)."""
    low = i.bitwiseAND(F.lit(0x7FFFFFFF))
    cube = ((low * low) % F.lit(1 << 31) * low) % F.lit(1 << 31)
    bits = s0 + F.bit_count(s1.bitwiseAND(low)) + F.bit_count(s3.bitwiseAND(cube))
    return F.lit(1) - F.lit(2) * (bits % 2)


def sign_sql(i: str, s1: str, s3: str, s0: str) -> str:
    low = f"(({i}) & 2147483647)"
    cube = f"((({low} * {low}) % 2147483648 * {low}) % 2147483648)"
    return f"(1 - 2 * (({s0} + bit_count(({s1} & {low})::BIGINT) + bit_count(({s3} & {cube})::BIGINT)) % 2))"


def _bits(size: int) -> int:
    if size < 2 or size & (size - 1):
        raise ValueError("the sketch size must be a power of two, at least 2")
    return size.bit_length() - 1


def cw_sketch(cells: DataFrame, size: int, seed=1) -> DataFrame:
    """Clarkson-Woodruff: each row goes to one bucket with a random sign; one shuffle."""
    bits = _bits(size)
    s = [F.lit(_mask(seed, t)).cast("long") for t in ("s1", "s3", "s0")]
    rows = cells.select(bucket_hash(F.col("row"), bits, seed).alias("row"), "col", (sign(F.col("row"), s[0], s[1], s[2]) * F.col("val")).alias("val"))
    return rows.groupBy("row", "col").agg(F.sum("val").alias("val"))


def cw_sketch_sql(cells: str, size: int, seed=1) -> str:
    s = [f"{_mask(seed, t)}::BIGINT" for t in ("s1", "s3", "s0")]
    return f"SELECT {bucket_hash_sql('row', _bits(size), seed)} AS row, col, sum({sign_sql('row', *s)} * val) AS val FROM {cells} GROUP BY ALL"


def _row_mask(seed, r: F.Column, tag: str) -> F.Column:
    return F.floor(rng.uniform(f"{seed}{tag}", r) * F.lit(float(1 << 31))).cast("long")


def rad_sketch(cells: DataFrame, size: int, seed=1) -> DataFrame:
    """Rademacher: (1/sqrt(size)) R A with R of +-1. Rows are size * cells before the partial sums."""
    r = F.broadcast(cells.sparkSession.range(size).select(F.col("id").alias("r"), *[_row_mask(seed, F.col("id"), t).alias(t) for t in ("s1", "s3", "s0")]))
    rows = cells.join(r).select("r", "col", (sign(F.col("row"), F.col("s1"), F.col("s3"), F.col("s0")) * F.col("val")).alias("val"))
    return rows.groupBy(F.col("r").alias("row"), "col").agg((F.sum("val") / F.lit(float(size) ** 0.5)).alias("val"))


def rad_sketch_sql(cells: str, size: int, seed=1) -> str:
    m = {t: f"floor({rng.uniform_sql(f'{seed}{t}', 'r')} * 2147483648.0)::BIGINT" for t in ("s1", "s3", "s0")}
    return f"""SELECT r AS row, col, sum({sign_sql('row', 's1', 's3', 's0')} * val) / {float(size) ** 0.5!r} AS val
FROM {cells}, (SELECT r, {m['s1']} AS s1, {m['s3']} AS s3, {m['s0']} AS s0 FROM range({size}) t(r)) GROUP BY r, col"""


def srht_sketch(cells: DataFrame, rows: int, size: int, seed=1) -> DataFrame:
    """Subsampled randomized Hadamard transform: sign flips, Hadamard entries by parity,
    ``size`` of the padded rows without replacement, 1/sqrt(size). Row ids are 0 to below
    ``rows`` padded to a power of two; another id is an error."""
    padded = 1 << max(0, rows - 1).bit_length()
    spark = cells.sparkSession
    picked = spark.range(padded).select(F.col("id").alias("p"), rng.uniform(f"{seed}p", "id").alias("u")).orderBy("u", "p").limit(size)
    ranked = spark.createDataFrame([(i, int(r["p"])) for i, r in enumerate(picked.collect())], "r long, p long")  # size rows
    s = [F.lit(_mask(seed, t)).cast("long") for t in ("s1", "s3", "s0")]
    entry = sign(F.col("row"), *s) * (F.lit(1) - F.lit(2) * (F.bit_count(F.col("p").bitwiseAND(F.col("row"))) % 2))
    fits = F.col("row").isNull() | F.col("row").between(0, padded - 1)
    cells = cells.withColumn("row", F.when(fits, F.col("row")).otherwise(F.raise_error(F.concat(F.lit(f"no row of {padded}: "), F.col("row").cast("string"))).cast("long")))
    out = cells.join(F.broadcast(ranked)).select("r", "col", (entry * F.col("val")).alias("val"))
    return out.groupBy(F.col("r").alias("row"), "col").agg((F.sum("val") / F.lit(float(size) ** 0.5)).alias("val"))


def srht_sketch_sql(cells: str, rows: int, size: int, seed=1) -> str:
    padded = 1 << max(0, rows - 1).bit_length()
    s = [f"{_mask(seed, t)}::BIGINT" for t in ("s1", "s3", "s0")]
    return f"""SELECT r AS row, col, sum({sign_sql('row', *s)} * (1 - 2 * (bit_count((p & row)::BIGINT) % 2)) * val) / {float(size) ** 0.5!r} AS val
FROM {cells}, (SELECT row_number() OVER (ORDER BY {rng.uniform_sql(f'{seed}p', 'i')}, i) - 1 AS r, i AS p FROM range({padded}) t(i) QUALIFY r < {size}) GROUP BY r, col"""


def reduce_dimensions(cells: DataFrame, first: int, second: int, seed=1) -> DataFrame:
    """Words x documents -> Clarkson-Woodruff to ``first`` rows -> Rademacher to ``second`` -> documents x second."""
    from coreloom.operators.sparse import transpose

    return transpose(rad_sketch(cw_sketch(transpose(cells), first, seed), second, seed))
