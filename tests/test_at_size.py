"""What shows only on more rows than the small tables have: rounding, ties, work per row."""

import os
from collections import Counter

import numpy as np
from conftest import oracle
from pyspark.sql import functions as F

from coreloom.operators import blocks, lloyd, reduce, sampling
from coreloom.operators.assign import _pairs, pairwise
from coreloom.plans import registry


def test_draws_from_a_long_bucket(spark):
    items = spark.range(60_000).select("id", (1 + F.col("id") % 9).cast("double").alias("w"))
    draws = sampling.weighted_choice(items, 300, 5, buckets=2)
    assert "currentrow$(), unboundedfollowing$()" not in draws._jdf.queryExecution().toString().lower()  # such a frame is read again for every row
    ids = np.concatenate([np.arange(0, 60_000, 2), np.arange(1, 60_000, 2)])
    up = np.cumsum(1 + ids % 9)
    u = {r["id"]: r["u"] for r in spark.range(300).select("id", sampling.rng.uniform(5, F.col("id")).alias("u")).collect()}
    assert {r["draw"]: r["id"] for r in draws.collect()} == {i: ids[np.searchsorted(up, x * up[-1], "right")] for i, x in u.items()}


def test_bucket_hash_next_to_a_bound(spark):
    a, b = (reduce._odd(31, t) for t in "ab")
    rows = np.arange(10_000_000, dtype=np.uint64)
    x = rows * np.uint64(a) + np.uint64(b)  # modulo 2^64
    left = np.uint64(1 << 60) - x % np.uint64(1 << 60)
    near = rows[left < np.uint64(1 << 39)]  # a quotient of six places is that of the next bucket
    assert len(near)
    got = spark.createDataFrame([(int(r),) for r in near], "row long").select("row", reduce.bucket_hash(F.col("row"), 4, 31).alias("h")).collect()
    assert {r["row"]: r["h"] for r in got} == {int(r): ((int(r) * a + b) % 2**64) >> 60 for r in near}


def test_rays_a_point_lies_behind(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(6000, 16)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/t")
    os.makedirs(f"{tmp_path}/in")
    os.rename(next(iter((tmp_path / "t").glob("*.parquet"))), f"{tmp_path}/in/embeddings.parquet")
    own = {r["id"]: (r["cluster"], r["ray"]) for r in registry.QUERIES["ray_assigned"](spark, f"{tmp_path}/in").collect()}
    want = oracle(registry.ORACLES["ray_assigned"], f"{tmp_path}/in")
    behind = [i for i, (c, _) in own.items() if (v[i, :3] < v[c, :3]).all()]
    assert any(own[i][1] > 1 for i in behind)  # equally far by definition, by rounding not
    assert own == {r.id: (r.cluster, r.ray) for r in want.itertuples()}


def points(spark, path, v) -> str:
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_snap_in_blocks(spark, tmp_path):
    v = np.random.default_rng(2).integers(-2, 3, size=(2500, 3)).astype(float)  # many copies: the lowest id counts
    rows = registry.QUERIES["snap_to_points"](spark, points(spark, tmp_path, v))
    assert "BroadcastNestedLoopJoin" not in plan(rows)  # a row for each pair, all sorted
    d = (((v[::10] * 1.01)[:, None] - v) ** 2).sum(2)
    assert {r["idx"]: r["id"] for r in rows.collect()} == dict(zip(range(0, 2500, 10), d.argmin(1)))


def test_pairs_in_blocks_round_as_the_sql(spark, tmp_path):
    r = np.random.default_rng(4)
    v = r.normal(size=(700, 8))
    v = np.vstack([v, v[:40], v[:40] + 1e-4, 1e6 + v[:40]])  # copies, near pairs, far from 0
    rows = registry.QUERIES["pairwise_distances"](spark, points(spark, tmp_path, v))
    assert "MapInArrow" in plan(rows)
    got = rows.toPandas().sort_values(["a", "b"])
    t = np.cumsum((v[:, None] - v) ** 2, axis=2)[:, :, -1] * 1e6
    want = (np.floor(t) + (t - np.floor(t) >= 0.5)) / 1e6
    assert len(got) == len(v) ** 2 and (got["dist"].to_numpy().reshape(len(v), -1) == want).all()


def test_swaps_in_blocks(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(900, 4))
    v = np.vstack([v, v[:30], 1e4 + v[:30], 1e4 + v[:30]])
    rows = registry.QUERIES["local_search_swap"](spark, points(spark, tmp_path, v))
    assert "MapInArrow" in plan(rows)
    got = {(r["closed"], r["opened"]): r["cost"] for r in rows.collect()}
    d = ((v[:, None] - v) ** 2).sum(2)
    for c in range(5):
        stay = d[:, [i for i in range(5) if i != c]].min(1)
        want = np.minimum(stay[:, None], d).sum(0)
        assert np.allclose([got[c, q] for q in range(5, len(v))], want[5:], rtol=1e-10, atol=1e-6)
    assert len(got) == 5 * (len(v) - 5)


def test_runs_of_lloyd_share_their_passes(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(300, 3))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    starts = [p.where(F.col("id") < k).select(F.col("id").alias("cid"), "v") for k in (2, 5, 9)]
    alone = [lloyd.lloyd(p, c)[1] for c in starts]
    passes, steps = [], lloyd.steps
    monkeypatch.setattr(lloyd, "steps", lambda points, runs: passes.append(len(runs)) or steps(points, runs))
    together = [costs for _, costs in lloyd.lloyd_runs(p, starts)]
    assert [len(c) for c in together] == [len(c) for c in alone] and all(np.allclose(a, b) for a, b in zip(together, alone))
    assert len(passes) == max(map(len, alone)) and passes[0] == 3 == passes[-1]


def test_pairs_and_their_copies_share_a_page(spark, tmp_path):
    v = np.random.default_rng(8).normal(size=(1500, 8))
    rows = registry.QUERIES["pairwise_distances"](spark, points(spark, tmp_path, v))
    rows.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("a", "b").count().where("count = 1").count() == 1500**2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * 1500**2  # with every distance kept twice it was 9 bytes a row


def test_pairs_of_any_ids_and_blocks(spark):
    r = np.random.default_rng(9)
    ids = [None, None, None, -7, 2**62, 2**62 + 1, *r.integers(0, 90, 300).tolist()]
    v = r.integers(-3, 4, size=(len(ids), 2)).astype(float)
    rows = spark.createDataFrame(list(zip(ids, v.tolist())), "id long, v array<double>").repartition(3)
    want = Counter((a, b, ((x - y) ** 2).sum()) for a, x in zip(ids, v) for b, y in zip(ids, v))
    assert Counter(map(tuple, pairwise(rows, whole=True, digits=6).collect())) == want
    mixed = blocks.met(blocks.spread(rows, "a", by="id"), blocks.spread(rows, "b"))  # blocks of one table that are not those of the other
    assert Counter(map(tuple, mixed.mapInArrow(_pairs(None), "a long, b long, dist double").collect())) == want
