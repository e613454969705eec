"""Closed forms, invariants, fixtures and round trips."""

import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coreloom.functions import rng, vec
from coreloom.operators import aggregates, coresets, evaluate, hard_instance, kmeans1d, lloyd, local_search, reduce, rings, sampling, seeding, sparse
from coreloom.operators.assign import nearest, nearest_sql
from coreloom.plans import experiments, report
from coreloom.sources import readers, sinks
from coreloom.streaming import cf_stream

TEN = [
    (-7.237310391208174, -9.031086522545417), (-8.16550136087066, -7.008504394784431), (-7.022668436942146, -7.570412890908223), (-8.863943061317665, -5.0532398146772355), (0.08525185826796045, 3.6452829679480585),
    (-0.794152276623841, 2.104951171962879), (-1.340520809891421, 4.157119493365752), (-10.32012970766661, -4.33740290203162), (-2.187731658211975, 3.333521246686991), (-8.535604566608127, -6.013489256860859),
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>").repartition(parts)


def centers(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "cid long, v array<double>")


def test_distances(spark):
    p = frame(spark, TEN)
    got = {(r["a"], r["b"]): r["d"] for r in p.select(F.col("id").alias("a"), F.col("v").alias("x")).join(p.select(F.col("id").alias("b"), F.col("v").alias("y"))).select("a", "b", vec.d2("x", "y").alias("d")).collect()}
    assert round(got[0, 1], 2) == 4.95 and round(got[0, 4], 2) == 214.31 and round(got[4, 8], 2) == 5.26


def test_kl_rejects_non_positive(spark):
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT array(1D, 0D) a, array(1D, 2D) b").select(vec.kl("a", "b")).collect()


def test_nearest_paths_agree_and_ties_go_low(spark):
    p, c = frame(spark, [*TEN, (0.0, 0.0)]), centers(spark, [(1, 0), (-1, 0), (1, 0)])
    a = {r["id"]: (r["cluster"], round(r["d2"], 9)) for r in nearest(p, c).collect()}
    b = {r["id"]: (r["cluster"], round(r["d2"], 9)) for r in nearest_sql(p, c).collect()}
    assert a == b and a[10] == (0, 1.0)


def test_nearest_without_centers_or_points(spark):
    assert nearest(frame(spark, TEN), centers(spark, [(0, 0)]).limit(0)).count() == 0
    assert nearest(frame(spark, TEN).limit(0), centers(spark, [(0, 0)])).count() == 0


@pytest.mark.parametrize(("x", "best"), [([4.0, 4.1, 4.2, -50, 200.2, 200.4, 200.9, 80, 100, 102], 296.28), ([-4, -5, -1, 0, 4, -4, -6, 7, 8, 10, 22], 21.416666666666668)])
def test_kmeans1d_fixtures(x, best):
    cost, label = kmeans1d.solve(np.array(x, float), 4)
    assert cost == pytest.approx(best)
    assert len(set(label)) == 4


def test_kmeans1d_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(40):
        x = np.sort(draw.normal(size=draw.integers(1, 10)))
        k = int(draw.integers(1, 5))
        best = min(sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip((0, *cut), (*cut, len(x)))) for cut in itertools.combinations(range(1, len(x)), min(k, len(x)) - 1))
        assert kmeans1d.solve(x, k)[0] == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize(("beta", "cost"), [(1.0, 36.0), (2.0, 5.625)])
def test_hard_instance_closed_form(spark, beta, cost):
    rows = hard_instance.rows(spark, 3, 3, beta)
    means = aggregates.centroids(rows.withColumn("cluster", hard_instance.block_cluster(3, 0)))
    assert evaluate.cost(rows, means).first()["cost"] == pytest.approx(cost)
    assert hard_instance.closed_cost(3, 3, beta) == pytest.approx(cost)


def test_published_closed_cost():
    assert hard_instance.closed_cost(10, 6) == pytest.approx(4_500_000.0)


def test_instance_names():
    assert hard_instance.parse_name("x/benchmark-k10-alpha6-beta1.00.txt.gz") == (10, 6, 1.0)
    with pytest.raises(ValueError):
        hard_instance.parse_name("nothing")


def grid(n=400, seed=1):
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.normal(c, 0.5, size=(n // 4, 2)) for c in ((0, 0), (10, 0), (0, 10), (10, 10))])


def test_basic_and_stream_weights_add_up(spark):
    p = frame(spark, grid())
    for make in (coresets.basic, coresets.stream_km):
        assert make(p, 10, 1).agg(F.sum("w")).first()[0] == 400


def test_sensitivity_mass(spark):
    p = frame(spark, grid())
    c = coresets.sensitivity(p, 4, 60, 1)
    total = c.agg(F.sum("w")).first()[0]
    assert total >= 400 - 1e-6
    sums = evaluate.distortions(p, c, [centers(spark, [(0, 0), (10, 0), (0, 10), (10, 10)])]).first()
    assert sums["distortion"] < 1.5


def test_group_sampling_partitions_the_points(spark):
    p = frame(spark, grid())
    own = rings.ring_points(nearest(p, centers(spark, [(0, 0), (10, 0), (0, 10), (10, 10)])).withColumn("cost", F.sqrt("d2")))
    assert own.count() == 400 and own.where("kind = 'ring' and ring is null").count() == 0
    c = coresets.group_sampling(p, 4, 80, 2)
    assert c.agg(F.sum("w")).first()[0] == pytest.approx(400, rel=0.35)


def test_zero_cost_cluster_is_shortfall(spark):
    own = rings.ring_points(spark.createDataFrame([(1, 0, 0.0), (2, 1, 1.0), (3, 1, 1.0)], "id long, cluster long, cost double"))
    assert {r["id"]: r["kind"] for r in own.collect()} == {1: "shortfall", 2: "ring", 3: "ring"}


def test_ray_coreset_conserves_mass_on_request(spark):
    p = frame(spark, grid())
    assert coresets.ray_maker(p, 4, 60, 3, conserve_mass=True).agg(F.sum("w")).first()[0] == 400
    assert coresets.ray_maker(p, 4, 60, 3).agg(F.sum("w")).first()[0] <= 400


def test_seeding_is_independent_of_partitions(spark):
    a = seeding.kmeanspp(frame(spark, grid(), 1), 12, 3).orderBy("round").collect()
    b = seeding.kmeanspp(frame(spark, grid(), 8), 12, 3).orderBy("round").collect()
    assert [r["cid"] for r in a] == [r["cid"] for r in b] and len({r["cid"] for r in a}) == 12


def test_seeding_stops_at_distinct_points(spark):
    assert seeding.kmeanspp(frame(spark, [(1, 1)] * 5 + [(2, 2)] * 5), 6, 1).count() == 2


def test_lloyd_finds_blobs(spark):
    p = frame(spark, grid())
    best, cost = lloyd.best_of(p, 4, (1, 2, 3))
    assert cost < 400 and sorted(tuple(round(x / 10) for x in r["v"]) for r in best.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    many = seeding.kmeans_parallel(p, 4, 1)
    assert many.count() == 4


def test_empty_cluster_keeps_its_center(spark):
    out, _ = lloyd.lloyd(frame(spark, [(0, 0), (1, 1)]), centers(spark, [(0, 0), (100, 100)]), 3)
    assert [r["v"] for r in out.orderBy("cid").collect()][1] == [100.0, 100.0]


def test_local_search_matches_brute_force(spark):
    x = grid(40, 3)
    p = frame(spark, x)
    got = {(r["closed"], r["opened"]): r["cost"] for r in local_search.swap_costs(p, centers(spark, x[:3]), p.where("id < 8")).collect()}
    for (closed, opened), cost in got.items():
        c = [x[opened] if i == closed else x[i] for i in range(3)]
        assert cost == pytest.approx(sum(min(((y - z) ** 2).sum() for z in c) for y in x))
    assert list(local_search.permutations(3, 2))[:2] == [(0, 1), (0, 2)]


def test_enclosing_ball(spark):
    c, r = evaluate.enclosing_ball(frame(spark, [(0, 0), (2, 0), (1, 0.2)]), 60)
    assert c[0] == pytest.approx(1, abs=0.1) and r == pytest.approx(1, abs=0.1)
    inside = evaluate.random_in_ball(spark, c, r, 20, 1).collect()
    assert all(math.dist(q["v"], c) <= r + 1e-9 for q in inside)


def test_candidate_solutions(spark):
    p = frame(spark, grid())
    c = coresets.basic(p, 20, 1)
    rows = evaluate.distortions(p, c, evaluate.candidate_solutions(c, 4, (1, 2))).collect()
    assert len(rows) == 2 and all(1 <= r["distortion"] < 2 for r in rows)


def test_draws(spark):
    items = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "id long, w double")
    got = [r["id"] for r in sampling.weighted_choice(items, 2000, 5).collect()]
    assert len(got) == 2000 and 1 not in got and got.count(2) / 2000 == pytest.approx(0.75, abs=0.04)
    mean = spark.range(4000).agg(F.avg(rng.normal(1, "id")), F.var_samp(rng.normal(1, "id")), F.avg(rng.stochastic_round(F.lit(2.25), rng.uniform(2, "id")))).first()
    assert abs(mean[0]) < 0.06 and mean[1] == pytest.approx(1, abs=0.1) and mean[2] == pytest.approx(2.25, abs=0.03)


def test_sparse_fixture(spark):
    cells = spark.createDataFrame([(0, 0, 8.0), (0, 2, 2.0), (1, 2, 5.0), (4, 2, 7.0), (4, 3, 1.0), (4, 4, 2.0), (6, 3, 9.0)], "row long, col long, val double")
    rows = sparse.csr(cells).orderBy("row").collect()
    assert [(r["row"], r["start"], r["cols"]) for r in rows] == [(0, 0, [0, 2]), (1, 2, [2]), (4, 3, [2, 3, 4]), (6, 6, [3])]
    assert {r["id"]: r["v"] for r in sparse.densify(cells, 5).collect()}[4] == [0, 0, 7, 1, 2]


def test_sketch_sizes_and_mass(spark):
    with pytest.raises(ValueError):
        reduce.cw_sketch(spark.createDataFrame([], "row long, col long, val double"), 12)
    x = np.random.default_rng(2).normal(size=(64, 3))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(64) for j in range(3)], "row long, col long, val double")
    want = (x**2).sum()
    for make in (lambda s: reduce.cw_sketch(cells, 32, s), lambda s: reduce.rad_sketch(cells, 32, s), lambda s: reduce.srht_sketch(cells, 64, 32, s)):
        got = np.mean([make(s).agg(F.sum(F.col("val") * F.col("val"))).first()[0] for s in range(3)])
        assert got == pytest.approx(want, rel=0.6)


def test_svd_projection_and_lift(spark):
    x = np.outer(np.arange(1, 7), [1.0, 2.0, 2.0])
    reduced, v = reduce.project_svd(frame(spark, x), 1)
    back = {r["cid"]: r["v"] for r in reduce.lift(reduced.withColumnRenamed("id", "cid"), v).collect()}
    assert back[3] == pytest.approx(list(x[3]))


def test_features_add_and_subtract(spark):
    rows = aggregates.features(frame(spark, TEN).withColumn("cluster", F.lit(0)))
    zero = aggregates.merge_features(rows, rows, -1).first()
    assert zero["n"] == 0 and zero["ss"] == pytest.approx(0)


def test_cf_summary_is_bounded_and_exact(spark):
    x = grid(1000, 5)
    out = cf_stream.merge_features(cf_stream.compress_points(frame(spark, x, 5), 30), 30)
    row = out.agg(F.count("*"), F.sum("n"), F.sum("ss"), F.sum(F.col("ls")[0])).first()
    assert row[0] <= 30 and row[1] == 1000 and row[2] == pytest.approx((x**2).sum()) and row[3] == pytest.approx(x[:, 0].sum())
    same = cf_stream.summarize(frame(spark, [(1, 1)] * 50), 5).collect()
    assert sum(r["w"] for r in same) == 50


def test_readers(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(text)
        return str(path)

    assert [r["v"] for r in readers.dense_csv(spark, put("a.csv.gz", "1,2\n\n3,4\n5\n")).orderBy("id").collect()] == [[1, 2], [3, 4]]
    with pytest.raises(Exception, match="not a number"):
        readers.dense_csv(spark, put("b.csv", "1,x\n")).collect()
    assert [r["v"] for r in readers.census(spark, put("c.csv", "id,a,b\n7,1,2\n8,3,4\n9,3\n"), 2).orderBy("id").collect()] == [[1, 2], [3, 4]]
    assert [r["v"] for r in readers.covertype(spark, put("d.csv", "1,2,9\n3,4,9\n"), 2, 2).orderBy("id").collect()] == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        readers.covertype(spark, str(tmp_path / "d.csv"), 2, 3)
    assert [r["v"] for r in readers.tower(spark, put("Tower.txt", "1\n2\n3\n4\n5\n6\n")).orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [r["v"] for r in readers.tower(spark, put("Tower2.txt", "1\n2\n3\n\n4\n5\n6\n7\n8\n9\n")).orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    cells, shape = readers.bag_of_words(spark, put("docword.x.txt", "3\n4\n3\n1 1 2\n1 4 1\n3 2 5\n"))
    assert shape == (3, 4, 3) and cells.count() == 3
    assert sorted(r["row"] for r in sparse.cells_of(cells, compact_rows=True).select("row").distinct().collect()) == [0, 1]
    assert readers.points(spark, str(tmp_path / "docword.x.txt")).count() == 2
    assert readers.points(spark, "benchmark-k3-alpha2-beta1.00.txt").count() == 9


def test_coreset_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(1, True, 2.5, [1.0, 0.1]), (2, False, 1.0, [3.0, 1e-9])], "idx long, is_center boolean, w double, v array<double>")
    sinks.write_coreset(c, str(tmp_path / "c"))
    back = readers.coreset(spark, str(tmp_path / "c")).collect()
    assert sorted((r["w"], *r["v"]) for r in back) == [(1.0, 3.0, 1e-9), (2.5, 1.0, 0.1)]
    sinks.write_centers(c.select(F.col("idx").alias("cid"), "v"), str(tmp_path / "k"))
    assert readers.weighted_centers(spark, str(tmp_path / "k")).count() == 2
    sinks.write_sparse(spark.createDataFrame([(0, 1, 2.0), (1, 1, 0.0)], "row long, col long, val double"), str(tmp_path / "s"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["1 2 2.0"]
    sinks.write_dense(frame(spark, [(1, 2), (3, 4)]), str(tmp_path / "t"), transpose=True)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1.0,3.0", "2.0,4.0"]
    assert readers.discover(spark, str(tmp_path), "*.gz").count() >= 3


def test_run_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"algorithm": "a", "k": 3, "start_time": "2020-01-01T00:00:00", "end_time": "2020-01-01T00:01:30"}')
    row = experiments.duration(experiments.read_runs(spark, str(tmp_path / "r.json"))).first()
    assert row["m"] == -1 and row["duration_secs"] == 90.0
    with pytest.raises(Exception, match="unknown name"):
        experiments.resolve(spark.createDataFrame([("zz",)], "a string"), "a", {"x": "y"}).collect()


def test_report_columns(spark):
    r = spark.sql("SELECT 'a/benchmark-k10-alpha6-beta1.00.txt' p").select(report.instance_parameters(F.col("p")).alias("x")).first()["x"]
    assert (r["k"], r["alpha"], r["beta"]) == (10, 6, 1.0)
    flat = report.minmax(spark.sql("SELECT 'a' d, 1.0D x UNION ALL SELECT 'a', 1.0D"), "d", "x").collect()
    assert all(x["norm"] is None for x in flat)
    assert [r["a"] for r in report.custom_order(spark.sql("SELECT explode(array('x','z','y')) a"), "a", ["z", "y"]).collect()] == ["z", "y", "x"]


def test_facts_and_latex_rows(spark):
    rows = spark.createDataFrame([("A k=20", 10, 200), ("A k=20", 20, 200), ("B", 10, 200), ("B", 10, 500), (None, 10, 200)], "dataset string, k int, coreset_size_factor int")
    kept = report.facts(rows, 200, ["B"], {"k=20": 20}).collect()
    assert sorted((r["dataset"] or "", r["k"]) for r in kept) == [("", 10), ("A k=20", 20)]
    assert report.facts(rows).count() == 5
    line = report.latex_rows(spark.sql("SELECT 'a_b & 5%' x, cast(null as int) y"), ["x", "y"]).first()["line"]
    assert line == r"a\_b \& 5\% &  \\"
    label = spark.sql("SELECT 1.0D m, cast(null as double) s").select(report.mean_std("m", "s").alias("x")).first()["x"]
    assert label == "1.00 (nan)"
    label = spark.sql("SELECT 27.125D m, 0.0625D s").select(report.mean_std("m", "s").alias("x")).first()["x"]
    assert label == f"{27.125:.2f} ({0.0625:.3f})" == "27.12 (0.062)"


def test_pruned_is_the_same_nearest():
    from coreloom.operators.assign import squared, squared_pruned

    draw = np.random.default_rng(4)
    for n, k, d in ((0, 3, 2), (500, 7, 3), (5000, 40, 2), (50, 1, 4)):
        x, c = draw.integers(0, 4, (n, d)).astype(float), draw.integers(0, 4, (k, d)).astype(float)
        every = ((x[:, None] - c) ** 2).sum(2)
        for found, d2 in (squared(x, c), squared_pruned(x, c)):
            assert (found == every.argmin(1)).all() and (d2 == every.min(1)).all()


def test_centers_must_be_finite(spark):
    evaluate.require_finite(centers(spark, [(0, 1)]))
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="not finite"):
            evaluate.require_finite(centers(spark, [(0, 1), (bad, 1)]))


def test_text_stream_skips_what_is_no_point(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,x,y\n7,1,2.5\n8,1\n9,x,2\n\n10, -3 ,4e1\n")
    rows = readers.text_stream(spark, str(tmp_path / "in"), 2, "first")
    run = rows.writeStream.format("memory").queryName("text_points").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["v"] for r in spark.table("text_points").collect()) == [[-3.0, 40.0], [1.0, 2.5]]


def test_import_without_optional_part():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_uniform_seeds(spark):
    points = spark.range(500).selectExpr("id * 3 AS id", "array(cast(id AS double)) AS v")
    from coreloom.operators import seeding

    got = [r["cid"] for r in seeding.uniform_seeds(points, 40, 5).collect()]
    assert 30 <= len(got) <= 40 and len(set(got)) == len(got) and max(got) > 900 and min(got) < 600
    assert sorted(got) == sorted(r["cid"] for r in seeding.uniform_seeds(points.repartition(5), 40, 5).collect())
