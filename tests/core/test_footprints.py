"""Losses of jittered footprints and tails against plain Python."""

import numpy as np
import pytest

from perilmesh.operators.cohort import exact_quantiles
from perilmesh.operators.loss import footprint_losses, tails

RINGS = [(0, [(0, 0), (3, 0.2), (2.8, 3), (0.1, 2.9)], 1.1), (1, [(0.5, 0.5), (1.5, 0.5), (1.0, 1.7)], 0.7), (2, [(9, 9), (9.1, 9), (9.1, 9.1)], 1.0)]


def _holds(ring, x, y):
    out = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay + 1e-15) + ax:
            out = not out
    return out


def _distance(ring, x, y):
    best = 1e9
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        t = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
        t = min(1.0, max(0.0, t))
        best = min(best, float(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))))
    return best


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(3)
    points = [(f"c{i % 7}", float(x), float(y), 1000.0 + i, "masonry") for i, (x, y) in enumerate(rng.uniform(-0.5, 3.5, (600, 2)))]
    points += [("c0", None, 1.0, 5.0, "masonry")]
    policies = spark.createDataFrame(points, "cohort_id string, lon double, lat double, tiv double, build_type string")
    rows = [(k, [(float(x), float(y)) for x, y in [*r, r[0]]], f) for k, r, f in RINGS]
    return points[:-1], policies, spark.createDataFrame(rows, "k long, ring array<struct<x: double, y: double>>, factor double")


@pytest.mark.parametrize("peril, ratio, width, most", [("hail", 0.1, 0.0, 500_000), ("hail", 0.1, 0.0, 1), ("tornado", None, 40.0, 500_000)])
def test_footprints_are_those_of_each_policy(scene, peril, ratio, width, most):
    points, policies, rings = scene
    got = {(r["cohort_id"], r["k"]): r["loss"] for r in footprint_losses(policies, rings, peril, 1.0, width_km=width, most_cells=most).collect()}
    from perilmesh.functions import fixed as X

    ratio = X.DAMAGE["masonry"][peril]
    want = {}
    for c, x, y, tiv, _ in points:
        for k, ring, f in RINGS:
            if _holds(ring, x, y):
                decay = np.exp(-_distance(ring, x, y) * 111.0 / (width / 2)) if width else 1.0
                want[c, k] = want.get((c, k), 0.0) + tiv * ratio * decay * f
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[key] - want[key]) < 0.02 for key in want)


def test_no_rings_and_no_policies(scene):
    _, policies, rings = scene
    assert footprint_losses(policies, rings.limit(0), "hail", 1.0).count() == 0
    assert footprint_losses(policies.limit(0), rings, "hail", 1.0).count() == 0


def test_tails_in_one_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(c, float(v)) for c, n in (("a", 1000), ("b", 3), ("d", 1)) for v in rng.lognormal(3, 1, n)]
    got = {r["cohort_id"]: r for r in tails(spark.createDataFrame(rows, "cohort_id string, loss double")).collect()}
    for c in "abd":
        v = np.array([x for k, x in rows if k == c])
        q = np.quantile(v, 0.99)
        assert got[c]["p50"] == pytest.approx(np.quantile(v, 0.5)) and got[c]["p99"] == pytest.approx(q)
        assert got[c]["tvar"] == pytest.approx(v[v >= q - 1e-9].mean(), rel=1e-6)


@pytest.mark.parametrize("values", [[1.0, 2.0], [5.0] * 40, list(range(500)), [0.0] * 300 + [1e-300, 1e300] + [2.0] * 300])
def test_quantiles_are_exact_with_few_values_listed(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = exact_quantiles(df, "x", (0.0, 0.2, 0.5, 0.77, 1.0), most_values=5)
    assert np.allclose(got, np.quantile(np.array(values, float), (0.0, 0.2, 0.5, 0.77, 1.0)), rtol=1e-12)
