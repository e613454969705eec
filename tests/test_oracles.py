"""Every registered query of the reference's operators against its SQL at the smallest size."""

import os

import pytest
from conftest import oracle, same

from coreloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), oracle(registry.ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = registry.flagship(spark, SF).collect()
    assert rows and all(r["distortion"] >= 1 for r in rows)


def test_svd_mass(spark):
    r = registry.QUERIES["truncated_svd_mass"](spark, SF).first()
    assert r["mass"] == pytest.approx(r["expected"], rel=1e-6)


def test_pca_ratios_add_up(spark):
    rows = registry.QUERIES["pca_explained_variance"](spark, SF).collect()
    assert sum(r["ratio"] for r in rows) == pytest.approx(1.0)


def test_lloyd_cost_does_not_rise(spark):
    costs = [r["cost"] for r in registry.QUERIES["lloyd_converged"](spark, SF).orderBy("iteration").collect()]
    assert all(b <= a * (1 + 1e-12) for a, b in zip(costs, costs[1:]))


def test_candidate_distortions(spark):
    rows = registry.QUERIES["candidate_distortions"](spark, SF).collect()
    assert sorted(r["solution"] for r in rows) == list(range(5)) and all(1 <= r["distortion"] < 2 for r in rows)
