"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Sources in code-point order (null last) get the weights in turn and share the corpus'
words by weight; a source stops at ``max_epochs`` times its size and the excess goes to
the others by weight until none is above (solved in one pass over the sorted caps).
A source takes its whole epochs of every document first; the rest of its target goes to
documents in the order of keys ``-ln(1 - u) / quality``, u from a hash of the id, up to
the budget by prefix sum. The document across the edge is taken if that is nearer.

The quality of a document is a positive column of the caller. The query takes it from the
table ``labels``: ``QUALITY`` for documents judged good, not judged, and judged bad (the
smallest label of an id counts).

The prefix sum never meets in one task: keys fall into ordered bins per source, ``COARSE``
quantiles of the source's own keys, each cut into ``FINE`` of equal width; bins are summed,
and only the documents of the one bin that holds a source's edge are ordered. The quantiles
are approximate, but they only say who is ordered where: the result doesn't depend on them.
Sources themselves (a row each) are ordered in one task.

Defined cases: null text has size 0 and takes 0; null source is a source of its own,
placed last; repeated rows and ties of keys are ordered by doc_id and size; an empty
table gives an empty one. Columns other than the named ones are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.llm.util import read_table, written

COARSE, FINE = 64, 16
#: Sources whose quantiles (half a KB each) are broadcast at most; more are joined.
BROADCAST_SOURCES = 20_000
#: Quality of a document with label 1, without one, with label 0.
QUALITY = (1.0, 0.5, 0.125)
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, key) -> F.Column:
    """Uniform in [0, 1) from md5, the same in any engine."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """sizes: source, source_size (one row a source) -> also target.

    One row a source meets here, never one a document."""
    n = len(weights)
    ordered = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ordered = ordered.select("source", "source_size", "at", F.element_at(cycle, ((F.col("at") - 1) % n + 1).cast("int")).alias("w"), (F.col("source_size") * float(max_epochs)).alias("cap"))
    rising = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("at"))
    before, after = rising.rowsBetween(W.unboundedPreceding, -1), rising.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    filled = ordered.withColumn("level", level).withColumn("rank", F.row_number().over(rising))
    chosen = F.min_by("level", F.when(F.col("cap") >= F.col("w") * F.col("level"), F.col("rank"))).over(W.partitionBy())
    return filled.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce(chosen, F.lit(0.0))).alias("target"))


def _binned(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``bin``: ordered ranges of a source's keys, none with much more than a
    ``COARSE``-th of its documents unless keys are equal."""
    at = [i / COARSE for i in range(COARSE + 1)]
    edges = keyed.groupBy("s").agg(F.percentile_approx("key", at, 10_000).alias("edges")).withColumnRenamed("s", "edge_s")
    edges = written(edges, "mix-edges")
    edges = F.broadcast(edges) if edges.count() <= BROADCAST_SOURCES else edges
    rows = keyed.join(edges, F.col("s") == F.col("edge_s"))
    below = F.greatest(F.size(F.filter("edges", lambda x: x < F.col("key"))), F.lit(1))
    rows = rows.withColumn("coarse", F.least(below, F.lit(COARSE)))
    low, high = F.element_at("edges", F.col("coarse")), F.element_at("edges", F.col("coarse") + 1)
    fine = F.when(high > low, F.floor((F.col("key") - low) / (high - low) * FINE)).otherwise(F.lit(0))
    fine = F.least(F.greatest(fine, F.lit(0)), F.lit(FINE - 1))
    return rows.withColumn("bin", (F.col("coarse") * FINE + fine).cast("int")).select(*keyed.columns, "bin")


def labelled_quality(docs: DataFrame, labels: DataFrame, as_: str) -> DataFrame:
    """``docs`` with a column from the labels (doc_id, quality) of their ids."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("label"))
    good, none, bad = QUALITY
    value = F.when(F.col("label") == 1, good).when(F.col("label").isNull(), none).otherwise(bad)
    return docs.join(known, docs["doc_id"] == known["label_id"], "left").select(*[docs[c] for c in docs.columns], value.alias(as_))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 7, quality=None, row_key: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken; ``quality`` is a positive column (default: from
    ``labels`` (doc_id, quality), or all alike). ``row_key`` names a column of ``docs`` that
    comes along in front."""
    carried = [row_key] if row_key else []
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    quality = F.lit(1.0) if quality is None else F.col(quality) if isinstance(quality, str) else quality
    # a null source and an empty name stay apart
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sized = docs.select(*carried, "doc_id", "source", name.alias("s"), words.alias("size"), quality.alias("quality"))
    if labels is not None:  # after the sizes, so that no text is shuffled
        sized = labelled_quality(sized.drop("quality"), labels, "quality")
    key = -F.log(1.0 - uniform(seed, F.col("doc_id"))) / F.col("quality")
    keyed = sized.select(*carried, "doc_id", "source", "s", "size", key.alias("key"))
    keyed = _binned(written(keyed, "mix"))
    bins = keyed.groupBy("s", "bin").agg(F.sum("size").alias("bin_size"), F.first("source").alias("source"))
    sizes = bins.groupBy("s").agg(F.first("source").alias("source"), F.sum("bin_size").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_epochs)
    targets = targets.select(F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("s"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    up_to = F.sum("bin_size").over(W.partitionBy("s").orderBy("bin"))
    placed = bins.withColumn("up_to", up_to).select("s", "bin", "up_to", (F.col("up_to") - F.col("bin_size")).alias("below"))
    placed = placed.join(plan, "s")
    rows = keyed.select(*carried, "doc_id", "s", "bin", "size", "key").join(placed, ["s", "bin"])
    out = [*carried, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).alias("taken")]
    edge = (F.col("below") < F.col("rest")) & (F.col("up_to") > F.col("rest"))
    clear = rows.where(~edge).withColumn("extra", F.when(F.col("up_to") <= F.col("rest"), 1).otherwise(0))
    order = W.partitionBy("s").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    near = rows.where(edge).withColumn("sum", F.col("below") + F.sum("size").over(order))
    over = F.col("sum") - F.col("rest")
    near = near.withColumn("extra", F.when((over <= 0) | ((over < F.col("size")) & (over < F.col("size") - over)), 1).otherwise(0))
    return clear.select(*out).unionAll(near.select(*out))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, for ``docs`` in which no two
    rows share a doc_id and none is null (an error otherwise: ``mixed_rows`` takes any rows)."""
    times = mixed.where("taken > 0").select(F.col("doc_id").alias("mix_id"), (F.col("taken") / F.col("size")).cast("int").alias("mix_times"))
    alone = F.when((F.count("*") == 1) & F.col("mix_id").isNotNull(), F.first("mix_times"))
    times = times.groupBy("mix_id").agg(F.coalesce(alone, F.raise_error(F.lit("rows share a doc_id or have none: use mixed_rows")).cast("int")).alias("mix_times"))
    rows = docs.select(F.col("doc_id").alias("own_id"), F.struct(*docs.columns).alias("row"))  # so that no name clashes
    return rows.join(times, F.col("own_id").eqNullSafe(F.col("mix_id"))).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("row.*")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes that row. Rows may share a doc_id or
    have none: each gets a key of its own, written with it so that it is the same in both reads."""
    own = docs.select(F.monotonically_increasing_id().alias("mix_row"), F.struct(*docs.columns).alias("row"))
    own = written(own, "mix-rows")
    mixed = mix_sources(own.select("mix_row", "row.doc_id", "row.source", "row.text"), row_key="mix_row", **how)
    times = mixed.where("taken > 0").select("mix_row", (F.col("taken") / F.col("size")).cast("int").alias("mix_times"))
    return own.join(times, "mix_row").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), labels=read_table(spark, sf_dir, "labels"))


SQL = r"""
WITH q AS (
  SELECT doc_id AS label_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CASE WHEN label = 1 THEN 1.0 WHEN label IS NULL THEN 0.5 ELSE 0.125 END::DOUBLE AS quality
  FROM documents LEFT JOIN q ON doc_id = label_id),
k AS (
  SELECT doc_id, source, size,
    -ln(1.0::DOUBLE - ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE) / quality AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM k GROUP BY source),
w AS (
  SELECT *, (CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, 3.0::DOUBLE * source_size::DOUBLE AS cap FROM s),
f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, pos) AS rank FROM w),
l AS (SELECT arg_min(level, rank) AS level FROM f WHERE cap >= w * level),
t AS (
  SELECT source, source_size, least(cap, w * coalesce(l.level, 0)) AS target FROM f LEFT JOIN l ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS up_to
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN up_to <= rest OR (up_to - rest < size AND up_to - rest < size - (up_to - rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
