"""Queries over whole tables, against brute force."""

import random

import numpy as np
import pytest

from coreloom.plans import registry


def test_paired_files_whole(spark, tmp_path):
    keys = range(1, 901)
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    paths = {f"f{k // 4}-svd-d5.csv" if k % 2 == 0 else f"f{k // 3}.csv" for k in keys}
    want = sorted((x, x.replace("-svd-d5", "")) for x in paths if "-svd" in x and x.replace("-svd-d5", "") in paths)
    got = sorted(map(tuple, registry.QUERIES["paired_files"](spark, str(tmp_path)).select("reduced", "original").collect()))
    assert got == want and max(int(x[0][1:].split("-")[0]) for x in got) > 200


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    r = random.Random(3)
    found = {i: [r.gauss(0, 1) for _ in range(4)] for i in range(60)}
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, v) for i, v in found.items()] + [(60, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, {i: np.array(v) for i, v in found.items()}


def test_pairwise_distances_whole(spark, vectors):
    path, v = vectors
    got = {(r["a"], r["b"]): r["dist"] for r in registry.QUERIES["pairwise_distances"](spark, path).collect()}
    assert len(got) == 60 * 60 and all(abs(x - ((v[a] - v[b]) ** 2).sum()) < 2e-6 for (a, b), x in got.items())


def test_local_search_swap_whole(spark, vectors):
    path, v = vectors
    got = {(r["closed"], r["opened"]): r["cost"] for r in registry.QUERIES["local_search_swap"](spark, path).collect()}
    assert set(got) == {(c, q) for c in range(5) for q in range(5, 60)}
    for (c, q), cost in got.items():
        centers = [v[i] for i in range(5) if i != c] + [v[q]]
        assert cost == pytest.approx(sum(min(((x - y) ** 2).sum() for y in centers) for x in v.values()), abs=2e-6)


def test_srht_rows_of_any_id(spark, tmp_path):
    from coreloom.operators import reduce

    rows = [(5, 1, 2.0), (5 + 32768, 1, 3.0), (70_000, 2, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    cells = spark.createDataFrame(rows, "row long, col long, val double")
    got = {(r["row"], r["col"]): r["val"] for r in registry.QUERIES["srht_sketch"](spark, str(tmp_path)).collect()}
    want = {(r["row"], r["col"]): r["val"] for r in reduce.srht_sketch(cells, 131072, 16, 41).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    with pytest.raises(Exception, match="no row of 32768"):
        reduce.srht_sketch(cells, 32768, 16, 41).collect()


def test_srht_beyond_32768_rows(spark, tmp_path):
    from conftest import oracle, same

    from coreloom.operators import reduce

    rows = [(k, 1 + k * 7 % 50, 900 + k % 1000 / 10) for k in range(0, 40_000, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    sql = registry.ORACLES["srht_sketch"].replace("range(32768)", "range(65536)")  # 40,000 padded; the SQL holds 32,768
    same(registry.QUERIES["srht_sketch"](spark, str(tmp_path)).toPandas(), oracle(sql, str(tmp_path)))
    # With every row of the transform taken, a sketch keeps the mass of each column: no two rows may share a Hadamard column.
    cells = spark.createDataFrame([(5, 1, 2.0), (5 + 32768, 1, 3.0)], "row long, col long, val double")
    assert sum(r["val"] ** 2 for r in reduce.srht_sketch(cells, 65536, 65536, 41).collect()) == pytest.approx(13)
