"""The registered queries: each applies operators to whole driver tables and rounds at the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coreloom.functions import rng, vec
from coreloom.operators import aggregates, coresets, evaluate, filters, hard_instance, local_search, lloyd, reduce, rings, sampling, seeding, sparse
from coreloom.operators.assign import nearest, nearest_by, pairwise, partition_cost, ray_assign
from coreloom.operators.kmeans1d import kmeans_1d
from coreloom.plans import experiments, report
from coreloom.session import shared_dir, stored, table
from coreloom.sources import readers, sinks
from coreloom.streaming import cf_stream

Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def fixed(points: DataFrame, low: int, high: int) -> DataFrame:
    return points.where(F.col("id").between(low, high - 1)).select(F.col("id").alias("cid"), "v")


def prices(spark, d) -> DataFrame:
    """Low-dimensional points: orders by price (in thousands) and month."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 1000.0, F.month("o_orderdate").cast("double")).alias("v"))


def assigned(spark, d) -> DataFrame:
    p = vectors(spark, d)
    return nearest(p, fixed(p, 0, 5))


def priced(spark, d) -> DataFrame:
    p = prices(spark, d)
    return nearest(p, fixed(p, 0, 10)).withColumn("cost", F.sqrt("d2"))


def sample(spark, d) -> DataFrame:
    """A fixed coreset of the vectors."""
    return vectors(spark, d).where("id % 10 = 0").select(F.col("id").alias("idx"), F.lit(False).alias("is_center"), (1 + F.col("id") % 7).cast("double").alias("w"), "v")


@query
def assign_fixed_centers(spark, d):
    return aggregates.cluster_stats(assigned(spark, d)).select("cluster", "n", F.round("cost", 6).alias("cost"))


@query
def cluster_avg_cost(spark, d):
    return aggregates.cluster_stats(assigned(spark, d)).select("cluster", F.round("avg_cost", 6).alias("avg_cost"))


@query
def normalized_cost(spark, d):
    return aggregates.normalized_cost(assigned(spark, d)).select("id", F.round("share", 9).alias("share"))


@query
def cluster_centroids(spark, d):
    return aggregates.centroids_long(assigned(spark, d)).select("cluster", "pos", F.round("val", 6).alias("val"))


@query
def weighted_centroids(spark, d):
    own = assigned(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return aggregates.centroids_long(own, "w").select("cluster", "pos", F.round("val", 6).alias("val"))


@query
def distinct_clusters(spark, d):
    return assigned(spark, d).select("cluster").distinct()


@query
def real_cost(spark, d):
    p = vectors(spark, d)
    return evaluate.cost(p, fixed(p, 0, 5)).select(F.round("cost", 6).alias("cost"))


@query
def coreset_cost(spark, d):
    p = vectors(spark, d)
    return evaluate.cost(evaluate.coreset_points(sample(spark, d)), fixed(p, 0, 5)).select(F.round("cost", 6).alias("cost"))


@query
def distortion_worst_of_5(spark, d):
    p = vectors(spark, d)
    rows = evaluate.distortions(p, sample(spark, d), [fixed(p, 5 * i, 5 * i + 5) for i in range(5)])
    return aggregates.worst_row(rows, "distortion", "solution").select("solution", F.round("real_cost", 6).alias("real_cost"), F.round("coreset_cost", 6).alias("coreset_cost"), F.round("distortion", 6).alias("distortion"))


@query
def coreset_center_cost(spark, d):
    p = vectors(spark, d)
    return evaluate.cost(p, p.where("id % 50 = 0").select(F.col("id").alias("cid"), "v")).select(F.round("cost", 6).alias("cost"))


@query
def snap_to_points(spark, d):
    p = vectors(spark, d)
    shifted = sample(spark, d).withColumn("v", vec.scale("v", F.lit(1.01)))
    return evaluate.snap(shifted, p).select("idx", "id")


@query
def ring_histogram(spark, d):
    rows = rings.ring_points(priced(spark, d)).where("kind = 'ring'")
    return rows.groupBy("ring").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query
def ringless_points(spark, d):
    rows = rings.ring_points(priced(spark, d)).where("kind <> 'ring'")
    rows.createOrReplaceTempView(view := f"ringless_{uuid.uuid4().hex}")
    return spark.sql(f"""SELECT cluster, count_if(kind = 'shortfall') AS n_short, count_if(kind = 'overshot') AS n_over,
        round(coalesce(sum(CASE WHEN kind = 'overshot' THEN cost END), 0), 4) AS over_cost FROM {view} GROUP BY GROUPING SETS ((), (cluster))""")


@query
def ring_groups(spark, d):
    rows = rings.groups(rings.ring_points(priced(spark, d))).where("kind = 'ring'")
    return rows.select("cluster", "ring", "n", F.round("group_cost", 4).alias("group_cost"), "band")


@query
def overshot_groups(spark, d):
    rows = rings.groups(rings.ring_points(priced(spark, d))).where("kind = 'overshot'")
    return rows.select("cluster", "n", F.round("group_cost", 4).alias("group_cost"), "band")


@query
def group_sample_plan(spark, d):
    rows = rings.sample_plan(rings.ring_points(priced(spark, d)), 200)
    return rows.select("kind", "cluster", "ring", "n", "action", F.round("share", 6).alias("share"), F.round("draws", 6).alias("draws"))


@query
def group_sampling_coreset(spark, d):
    p = prices(spark, d)
    rows = coresets.group_sampling(p, 5, 200, seed=3, centers=fixed(p, 0, 10))
    return rows.select("idx", "is_center", F.round("w", 4).alias("w"), F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query
def weighted_choice(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w"))
    return sampling.weighted_choice(items, 100, 7)


@query
def uniform_choice(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"))
    counts = items.select("grp").distinct().withColumn("m", F.lit(5).cast("long"))
    return sampling.uniform_choice(items, "grp", counts, 11)


@query
def sample_without_replacement(spark, d):
    return sampling.sample_without_replacement(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 50, 13)


@query
def weighted_reservoir(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("w"))
    return sampling.weighted_reservoir(items, 50, 17).select("id")


@query
def stochastic_round(spark, d):
    v = F.col("o_totalprice") / 1000.0
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rng.stochastic_round(v, rng.uniform(19, "o_orderkey")).alias("r"))


@query
def normal_vectors(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("id", "pos", F.round(rng.normal(23, "id", "pos"), 9).alias("x"))


@query
def sensitivity_coreset(spark, d):
    p = vectors(spark, d)
    rows = coresets.sensitivity(p, 5, 100, seed=1, centers=fixed(p, 0, 5))
    return rows.select("idx", "is_center", F.round("w", 5).alias("w"), F.round(F.col("v")[0], 6).alias("x"))


@query
def kmeanspp_seeds(spark, d):
    return seeding.kmeanspp(vectors(spark, d), 4, 5).select("cid", "round")


@query
def weighted_kmeanspp_seeds(spark, d):
    p = vectors(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return seeding.kmeanspp(p, 4, 6, weighted=True).select("cid", "round")


@query
def stream_kmpp_coreset(spark, d):
    return coresets.stream_km(vectors(spark, d), 4, 5).select("idx", "w", F.round(F.col("v")[0], 6).alias("x"))


@query
def basic_coreset(spark, d):
    return coresets.basic(vectors(spark, d), 4, 5).select("idx", "w", F.round(F.col("v")[0], 6).alias("x"))


@query
def lloyd_one_step(spark, d):
    p = vectors(spark, d)
    new, _ = lloyd.lloyd(p, fixed(p, 0, 5), iterations=1)
    return new.select("cid", F.posexplode("v").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@query
def weighted_lloyd_one_step(spark, d):
    p = vectors(spark, d).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    new, _ = lloyd.lloyd(p, fixed(p, 0, 5), iterations=1)
    return new.select("cid", F.posexplode("v").alias("pos", "x")).select("cid", "pos", F.round("x", 6).alias("x"))


@query
def lloyd_converged(spark, d):
    p = vectors(spark, d)
    _, costs = lloyd.lloyd(p, seeding.kmeanspp(p, 10, 1))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(costs)], "iteration int, cost double")


@query
def kmeans_cost_curve(spark, d):
    return lloyd.cost_curve(vectors(spark, d))


@query
def ray_assigned(spark, d):
    p = vectors(spark, d)
    rays = fixed(p, 0, 5).select(F.col("cid").alias("cluster"), F.col("v").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ray"))
    rays = rays.withColumn("dir", F.transform(F.sequence(F.lit(1), F.size("origin")), lambda i: F.when(i == F.col("ray"), 1.0).otherwise(0.0)))
    return ray_assign(assigned(spark, d).select("id", "v", "cluster"), rays).select("id", "cluster", "ray", F.round("length", 6).alias("length"), F.round("dist", 6).alias("dist"))


@query
def kmeans1d_exact(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000.0).alias("x"), F.lit(2).alias("k"))
    out = kmeans_1d(rows, ["grp"], "x", "k")
    return out.groupBy("grp").agg(F.round(F.max("cost"), 3).alias("cost"), F.count_if(F.col("label") == 0).alias("n_low"))


@query
def ray_coreset(spark, d):
    return coresets.ray_maker(vectors(spark, d), 5, 100, seed=2).select("idx", "w")


@query
def convex_candidates(spark, d):
    p = vectors(spark, d)
    return evaluate.convex_candidates(fixed(p, 0, 5), 20, 29).select("cid", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[63], 6).alias("y"))


@query
def meb_center(spark, d):
    c, r = evaluate.enclosing_ball(stored(vectors(spark, d), "ball"))
    return spark.createDataFrame([(i, x, r) for i, x in enumerate(c)], "pos int, x double, radius double")


@query
def farthest_point(spark, d):
    return evaluate.farthest_row(vectors(spark, d), [0.1] * 64).select("id", F.round("d2", 9).alias("d2"))


@query
def hard_instance_rows(spark, d):
    rows = hard_instance.rows(spark, 3, 3, 2.0)
    return rows.select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", F.round("x", 9).alias("x"))


def _hard_means(points, k):
    own = points.withColumn("cluster", hard_instance.block_cluster(k, 0))
    return aggregates.centroids(own)


@query
def hard_instance_block_cost(spark, d):
    rows = hard_instance.rows(spark, 4, 4, 2.0)
    return evaluate.cost(rows, _hard_means(rows, 4)).select(F.round("cost", 6).alias("cost"))


@query
def hard_instance_eval(spark, d):
    rows = hard_instance.rows(spark, 3, 3, 1.0)
    coreset = rows.where("id % 2 = 0").select(F.col("id").alias("idx"), (1.0 + F.col("id") % 3).alias("w"), "v")
    out = evaluate.hard_instance_eval(rows, coreset, 3, 3)
    return out.select("block_index", "epsilon", "n_non_deficient_centers", *[F.round(c, 6).alias(c) for c in ("coreset_cost", "real_cost", "distortion")])


@query
def bow_triples(spark, d):
    return sparse.bag_of_words(table(spark, d, "documents").select("doc_id", "text"))


def _length_cells(spark, d):
    words = sparse.word_counts(table(spark, d, "documents").select("doc_id", "text"))
    return words.groupBy(F.col("doc_id").alias("row"), F.least(F.length("word"), F.lit(16)).cast("long").alias("col")).agg(F.sum("cnt").cast("double").alias("val")).withColumn("col", F.col("col") - 1)


@query
def bow_dense_rows(spark, d):
    return sparse.densify(_length_cells(spark, d), 16).select("id", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), " ").alias("v"))


@query
def csr_rows(spark, d):
    return sparse.csr(_length_cells(spark, d)).select("row", "start", F.size("cols").alias("n"), F.array_join(F.transform("cols", lambda x: x.cast("string")), " ").alias("cols"), F.array_join(F.transform("vals", lambda x: x.cast("long").cast("string")), " ").alias("vals"))


@query
def sparse_lookup(spark, d):
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("row"), (F.col("doc_id") % 20).alias("col"))
    return sparse.lookup(_length_cells(spark, d), asked)


def _order_cells(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 8).alias("col"), F.col("o_totalprice").alias("val"))


@query
def cw_sketch(spark, d):
    return reduce.cw_sketch(_order_cells(spark, d), 16, 31).select("row", "col", F.round("val", 2).alias("val"))


@query
def rad_sketch(spark, d):
    return reduce.rad_sketch(_order_cells(spark, d), 8, 37).select("row", "col", F.round("val", 2).alias("val"))


@query
def srht_sketch(spark, d):
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("row"), (F.col("p_size") % 4).cast("long").alias("col"), F.col("p_retailprice").alias("val"))
    most = cells.agg(F.max("row")).first()[0] or 0
    return reduce.srht_sketch(cells, max(32768, most + 1), 16, 41).select("row", "col", F.round("val", 3).alias("val"))


@query
def reduce_dimensions(spark, d):
    return reduce.reduce_dimensions(_length_cells(spark, d), 8, 4, 43).select("row", "col", F.round("val", 6).alias("val"))


@query
def frobenius_mass(spark, d):
    return aggregates.frobenius(vectors(spark, d)).select(F.round("mass", 6).alias("mass"))


@query
def frobenius_difference(spark, d):
    p = vectors(spark, d)
    return aggregates.frobenius_difference(p, p.withColumn("v", vec.scale("v", F.lit(0.5)))).select(F.round("mass", 6).alias("mass"))


@query
def gram_matrix(spark, d):
    return aggregates.gram(vectors(spark, d)).select("i", "j", F.round("val", 6).alias("val"))


@query
def truncated_svd_mass(spark, d):
    p = vectors(spark, d)
    reduced, _, values = reduce.truncated_svd(p, 8)
    lost = aggregates.frobenius_difference(p, reduced)
    return lost.select("mass", F.lit(float((values[8:] ** 2).sum())).alias("expected"))


@query
def pca_explained_variance(spark, d):
    return reduce.explained_variance(vectors(spark, d))


@query
def l1_lp_kl_distances(spark, d):
    p = vectors(spark, d)
    c = F.broadcast(fixed(p, 0, 1).select(F.col("v").alias("c")))
    pairs = p.join(c)
    a, b = F.transform("v", lambda x: F.abs(x) + 0.01), F.transform("c", lambda x: F.abs(x) + 0.01)
    return pairs.select("id", F.round(vec.l1("v", "c"), 6).alias("l1"), F.round(vec.lp("v", "c", 3), 6).alias("l3"), F.round(vec.kl(a, b), 6).alias("kl"), F.round(vec.l2("v", "c"), 6).alias("l2"), F.round(vec.dot("v", "c"), 6).alias("dot"))


@query
def cf_summary(spark, d):
    rows = aggregates.features(assigned(spark, d))
    return rows.select("cluster", "n", F.round("ss", 6).alias("ss"), F.round(F.col("ls")[0], 6).alias("ls0"), F.round(F.col("ls")[63], 6).alias("ls63"))


@query
def cf_merge_cost(spark, d):
    own = assigned(spark, d)
    even, odd = aggregates.features(own.where("id % 2 = 0")), aggregates.features(own.where("id % 2 = 1"))
    merged = aggregates.merge_features(even, odd)
    centroid = F.transform("ls", lambda x: x / F.col("n"))
    return merged.select("cluster", "n", F.round(vec.cf_cost("n", "ls", "ss", centroid), 6).alias("cost"))


@query
def stream_cf_coreset(spark, d):
    base = f"{shared_dir(spark)}/cf-{uuid.uuid4().hex}"
    run = cf_stream.summarize_stream(readers.events_stream(spark, d), 64, f"{base}/state", f"{base}/log")
    state = cf_stream.finish(run, spark, f"{base}/state")
    return state.agg(F.sum("n").cast("long").alias("n"), F.round(F.sum(F.col("ls")[0]), 3).alias("ls0"), F.round(F.sum(F.col("ls")[1]), 3).alias("ls1"), F.round(F.sum("ss"), 2).alias("ss"))


@query
def cf_coreset(spark, d):
    return cf_stream.summarize(prices(spark, d), 64).agg(F.sum("w").cast("long").alias("n"), F.round(F.sum(F.col("w") * F.col("v")[0]), 2).alias("s0"), F.round(F.sum(F.col("w") * F.col("v")[1]), 2).alias("s1"))


def _results(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("algorithm"), F.col("p_size").alias("k"), F.col("p_retailprice").alias("distortion"), F.col("p_partkey").alias("seq"))


@query
def results_summary(spark, d):
    out = report.summary(_results(spark, d), ["dataset", "algorithm"], "distortion", "seq")
    return out.select("dataset", "algorithm", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "max")])


@query
def results_pivot(spark, d):
    rows = table(spark, d, "orders").withColumn("x", F.col("o_totalprice"))
    out = report.pivot(rows, ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "5-LOW"], "x")
    return out.select("o_orderstatus", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"))


@query
def cost_ratio(spark, d):
    return report.ratio(_results(spark, d), ["dataset", "k", "algorithm"], "distortion").withColumn("ratio", F.round("ratio", 6))


@query
def minmax_normalized(spark, d):
    return report.minmax(_results(spark, d), "dataset", "distortion").select("seq", F.round("norm", 6).alias("norm"))


@query
def group_maxima(spark, d):
    return _results(spark, d).groupBy("dataset").agg(F.max("distortion").alias("max_distortion"), F.max("k").alias("max_k"))


@query
def mean_std_label(spark, d):
    out = report.summary(_results(spark, d), ["algorithm"], "k", "seq")
    return out.select("algorithm", report.mean_std("mean", "std").alias("label"), report.k_label(F.col("n")).alias("k_label"), report.duration(F.col("mean") * 1000).alias("took"))


@query
def dataset_labels(spark, d):
    labels = [("ring", "Ring"), ("widget", "Widget")]
    return table(spark, d, "part").select("p_partkey", report.dataset_label(F.col("p_name"), labels).alias("label"))


@query
def unprocessed_runs(spark, d):
    runs = table(spark, d, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("name"), "o_custkey")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("run-"), F.col("o_orderkey")).alias("name"))
    return experiments.first_per_configuration(experiments.unprocessed(runs, done), ["o_custkey"], "name")


@query
def run_states(spark, d):
    o = table(spark, d, "orders")
    runs = o.select((F.col("o_custkey") % 700).alias("name"), F.col("o_orderdate").alias("queued_at"), F.col("o_orderkey").alias("run_id"))
    key = F.col("o_custkey").alias("name")
    return experiments.states(runs, o.where("o_orderstatus = 'P'").select(key), o.where("o_totalprice > 450000").select(key)).groupBy("status").agg(F.count("*").alias("n"))


@query
def experiment_grid(spark, d):
    datasets = table(spark, d, "region").select(F.col("r_name").alias("dataset"))
    algorithms = table(spark, d, "nation").select(F.col("n_name").alias("algorithm"))
    ks = spark.range(1, 6).select((F.col("id") * 10).cast("int").alias("k"))
    return experiments.grid(datasets, algorithms, ks, 3, 200)


@query
def alias_resolution(spark, d):
    aliases = {"brand#1": "one", "brand#2": "two", **{f"brand#{i}": f"b{i}" for i in range(3, 26)}}
    return experiments.resolve(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", aliases)


@query
def drop_nan_rows(spark, d):
    p = vectors(spark, d).withColumn("v", F.when(F.col("id") % 7 == 0, F.transform("v", lambda x: x * F.lit(float("nan")))).otherwise(F.col("v")))
    return filters.finite_rows(p).agg(F.count("*").alias("n"), F.round(F.sum(vec.norm2("v")), 6).alias("mass"))


@query
def local_search_swap(spark, d):
    """Every swap of one of five centres for any other point."""
    p = vectors(spark, d)
    out = local_search.swap_costs(p, fixed(p, 0, 5), p.where("not id between 0 and 4"), whole=True)
    return out.select("closed", "opened", F.round("cost", 6).alias("cost"))


@query
def local_search_run(spark, d):
    p = vectors(spark, d)
    found = local_search.local_search(p, fixed(p, 0, 5))
    return evaluate.cost(p, found)


@query
def row_gather(spark, d):
    p = vectors(spark, d)
    return filters.gather(p, p.where("id % 9 = 2").select("id")).select("id", F.round(F.col("v")[0], 6).alias("x"))


@query
def cluster_members(spark, d):
    return filters.cluster_points(assigned(spark, d), 2).select("id")


@query
def overshot_members(spark, d):
    return filters.overshot_points(rings.ring_points(priced(spark, d), beta=1)).select("id", "cluster")


@query
def bad_coordinates(spark, d):
    p = vectors(spark, d).withColumn("v", F.transform("v", lambda x: F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).when(F.col("id") % 13 == 0, F.lit(float("-inf"))).otherwise(x)))
    return filters.bad_coordinates(p)


@query
def set_intersection(spark, d):
    p = vectors(spark, d)
    return filters.intersection(p.where("id % 2 = 0"), p.where("id % 3 = 0"))


@query
def set_difference(spark, d):
    p = vectors(spark, d)
    return filters.difference(p.where("id % 2 = 0"), p.where("id % 3 = 0"))


@query
def prefix_sums(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("x"))
    return filters.ordered(rows, "grp", "x", "id")


def _files(parts):
    return parts.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 4), F.lit("-svd-d5.csv"))).otherwise(F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 3), F.lit(".csv"))).alias("path")).distinct()


@query
def paired_files(spark, d):
    return filters.pair_reduced_files(_files(table(spark, d, "part")))


@query
def nearest_l1(spark, d):
    p = vectors(spark, d)
    return nearest_by(p, fixed(p, 0, 5), vec.l1).select("id", "cluster", F.round("dist", 6).alias("dist"))


@query
def partition_costs(spark, d):
    p = vectors(spark, d)
    own = p.withColumn("cluster", F.col("id") % 5)
    return partition_cost(own, fixed(p, 0, 5)).select("cluster", F.round("cost", 6).alias("cost"))


@query
def pairwise_distances(spark, d):
    """The distances of all pairs of vectors."""
    return pairwise(vectors(spark, d), whole=True, digits=6)


@query
def union_of_frames(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b)


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _by_position(rows: DataFrame) -> DataFrame:
    """pos, n, total of the coordinates."""
    long = rows.select(F.posexplode("v").alias("pos", "x"))
    return long.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


@query
def dense_csv_round_trip(spark, d):
    """The vectors written as CSV and read back."""
    path = _folder(spark, "dense")
    sinks.write_dense(vectors(spark, d), path)
    return _by_position(readers.dense_csv(spark, path))


@query
def coreset_round_trip(spark, d):
    """A coreset written as weighted text and read back."""
    path = _folder(spark, "coreset")
    sinks.write_coreset(sample(spark, d).select("w", "v"), path)
    return readers.coreset(spark, path).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.round(F.sum(F.col("w") * vec.norm2("v")), 6).alias("mass"))


@query
def centers_round_trip(spark, d):
    """Centres written with weight 1 and read back without it."""
    path = _folder(spark, "centers")
    sinks.write_centers(fixed(vectors(spark, d), 0, 5), path)
    return readers.weighted_centers(spark, path).select("cid", F.posexplode("v").alias("pos", "x")).select("cid", "pos", F.round("x", 9).alias("x"))


def _text(spark, what: str, rows: DataFrame) -> str:
    """One file of the lines (at, value): the tables here are small by definition."""
    path = _folder(spark, what)
    rows.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query
def tower_points(spark, d):
    """One number a line, three lines a point, with a blank line after each nation of region 0."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("at"), F.explode(F.when(F.col("n_regionkey") == 0, F.array(F.col("n_nationkey").cast("string"), F.lit(""))).otherwise(F.array(F.col("n_nationkey").cast("string")))).alias("value"))
    points = readers.tower(spark, _text(spark, "tower", n.withColumn("at", F.col("at") * 2 + (F.col("value") == "").cast("int"))))
    return points.select("id", *[F.col("v")[i].alias(f"x{i}") for i in range(3)])


@query
def census_points(spark, d):
    """A header, the first attribute dropped, a line of another width skipped."""
    n = table(spark, d, "nation")
    body = n.select(F.col("n_nationkey").alias("at"), F.concat_ws(",", "n_nationkey", "n_regionkey", F.col("n_nationkey") * 10).alias("value"))
    extra = spark.createDataFrame([(-1, "caseid,a,b"), (1000, "7,7")], "at int, value string")
    points = readers.census(spark, _text(spark, "census", body.unionAll(extra)), 2)
    return points.select(*[F.col("v")[i].alias(f"x{i}") for i in range(2)])


@query
def covertype_points(spark, d):
    """The last attribute dropped."""
    n = table(spark, d, "nation")
    body = n.select(F.col("n_nationkey").alias("at"), F.concat_ws(",", "n_nationkey", "n_regionkey", F.lit(5)).alias("value"))
    points = readers.covertype(spark, _text(spark, "covertype", body), 2)
    return points.select(*[F.col("v")[i].alias(f"x{i}") for i in range(2)])


@query
def assign_pruned(spark, d):
    """The nearest of five centres, ruled out by a projection."""
    p = vectors(spark, d)
    return nearest(p, fixed(p, 0, 5), pruned=True).select("id", "cluster", F.round("d2", 6).alias("d2"))


@query
def squared_distances(spark, d):
    """Squares of the L1 and L3 distances from one vector."""
    p = vectors(spark, d)
    pairs = p.join(F.broadcast(fixed(p, 0, 1).select(F.col("v").alias("c"))))  # one row
    return pairs.select("id", F.round(vec.l1_squared("v", "c"), 4).alias("l1"), F.round(vec.lp_squared("v", "c", 3), 5).alias("l3"))


def _facts(spark, d):
    return _results(spark, d).withColumn("coreset_size_factor", F.when(F.col("seq") % 3 == 0, 500).otherwise(200))


@query
def filtered_facts(spark, d):
    """One size factor, without two data sets, no k below a data set's own."""
    rows = report.facts(_facts(spark, d), 200, ["Brand#11", "Brand#25"], {"#3": 20, "#4": 30})
    return rows.select("seq", "dataset", "k")


@query
def results_pivot_max(spark, d):
    out = report.pivot(_facts(spark, d).where("k <= 10"), ["dataset", "k"], "coreset_size_factor", [200, 500], "distortion", "max")
    return out.select("dataset", "k", F.round("200", 4).alias("m200"), F.round("500", 4).alias("m500"))


@query
def results_pivot_join(spark, d):
    rows = _facts(spark, d).groupBy("dataset", "coreset_size_factor", "k").agg(F.count("*").alias("n")).select("dataset", "coreset_size_factor", F.format_string("%02d:%d", "k", "n").alias("x"))
    out = report.pivot(rows, ["dataset"], "coreset_size_factor", [200, 500], "x", "join")
    return out.select("dataset", F.col("200").alias("m200"), F.col("500").alias("m500"))


@query
def latex_lines(spark, d):
    """The lines of a table of means and standard deviations."""
    out = report.summary(_results(spark, d), ["dataset", "algorithm"], "k", "seq")
    out = out.select("dataset", "algorithm", report.mean_std("mean", "std").alias("k"))
    return report.latex_rows(out, ["dataset", "algorithm", "k"]).select("line")


@query
def instance_names(spark, d):
    """The parameters in the file names of hard instances."""
    path = F.concat(F.lit("x/benchmark-k"), "p_size", F.lit("-alpha"), F.col("p_partkey") % 7, F.lit("-beta1.25.txt.gz"))
    return table(spark, d, "part").select("p_partkey", report.instance_parameters(path).alias("x")).select("p_partkey", "x.k", "x.alpha", "x.beta")


@query
def candidate_distortions(spark, d):
    """Five weighted k-means++ solutions on a sensitivity coreset, and how well it tells their costs."""
    p = vectors(spark, d)
    own = stored(coresets.sensitivity(p, 5, 200, seed=1), "coreset")
    return evaluate.distortions(p, own, evaluate.candidate_solutions(own, 5))


@query
def stream_text_summary(spark, d):
    """Points of comma-separated text, the last attribute dropped, summarised as a stream."""
    folder, base = _folder(spark, "stream-text"), _folder(spark, "stream-state")
    table(spark, d, "orders").select(F.concat_ws(",", F.col("o_custkey"), F.month("o_orderdate"), F.col("o_orderstatus")).alias("value")).write.text(folder)
    run = cf_stream.summarize_stream(readers.text_stream(spark, folder, 2, "last"), 64, f"{base}/state", f"{base}/log")
    state = cf_stream.finish(run, spark, f"{base}/state")
    return state.agg(F.sum("n").cast("long").alias("n"), F.round(F.sum(F.col("ls")[0]), 2).alias("ls0"), F.round(F.sum(F.col("ls")[1]), 2).alias("ls1"))
