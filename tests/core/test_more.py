import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_hulls_hold_all_points(spark):
    from perilmesh.operators.perils import convex_hulls

    rng = random.Random(1)
    pts = [(g, rng.randrange(20) / 2, rng.randrange(20) / 2) for g in ("a", "b") for _ in range(80)] + [("one", 1.0, 1.0), ("two", 1.0, 1.0), ("two", 2.0, 2.0)]
    got = {r.g: [(p.x, p.y) for p in r.ring] for r in convex_hulls(spark.createDataFrame(pts, "g string, lon double, lat double"), "g").collect()}
    for g in ("a", "b"):
        ring = got[g]
        assert ring[0] == ring[-1] and set(ring) <= {(x, y) for k, x, y in pts if k == g}
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            assert all((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) >= -1e-9 for k, x, y in pts if k == g)
    assert got["one"] == [(1.0, 1.0), (1.0, 1.0)] and set(got["two"]) == {(1.0, 1.0), (2.0, 2.0)}


def test_crps_equals_numeric_integration(spark):
    from perilmesh.operators.evaluate import crps

    levels, rows = [0.1, 0.5, 0.9], [(0.0, [1.0, 2.0, 4.0]), (1.5, [1.0, 2.0, 4.0]), (3.0, [1.0, 2.0, 4.0]), (9.0, [1.0, 2.0, 4.0]), (2.0, [2.0, 2.0, 2.0])]
    got = [r.crps for r in crps(spark.createDataFrame(rows, "y double, q array<double>"), levels).collect()]
    for (y, q), value in zip(rows, got):
        x = np.linspace(-5, 15, 400_001)
        cdf = np.where(x < q[0], 0.0, np.where(x >= q[-1], 1.0, np.interp(x, q, levels)))
        assert value == pytest.approx(np.trapezoid((cdf - (x >= y)) ** 2, x), abs=1e-3)


def test_assignments_keep_to_skills_hours_and_room(spark):
    from perilmesh.operators.evaluate import assign

    adjusters = spark.createDataFrame([(1, 27.0, -82.0, ["flood"]), (2, 27.0, -82.1, []), (3, 27.1, -82.0, ["flood"]), (4, 60.0, 0.0, [])], "adjuster_id long, home_lat double, home_lon double, skills array<string>")
    zones = spark.createDataFrame([(10, 27.0, -82.0, 1, "flood", 1.0), (11, 27.5, -82.0, 2, None, 1.0)], "zone_id long, lat double, lon double, capacity int, required_skill string, expected_claim_volume double")
    got = {r.adjuster_id: r.zone_id for r in assign(adjusters, zones).collect()}
    assert got == {1: 10, 2: 11, 3: 11}


def test_peril_generators(spark):
    from perilmesh.operators.perils import GENERATORS, STONES, circle, scenario_seed

    for name, make in GENERATORS.items():
        rows = make(spark, 400)
        assert rows.count() == 400 and rows.collect() == make(spark, 400).collect(), name
    stones = [r.diameter_mm for r in GENERATORS["hail"](spark, 4000).collect()]
    assert all(25 <= s <= 120 for s in stones) and abs(np.mean([s < 35 for s in stones]) - STONES[0][2]) < 0.06
    m = [r.magnitude for r in GENERATORS["earthquake"](spark, 4000).collect()]
    assert 5.53 <= min(m) and max(m) <= 8.0 and np.mean([x > 6.53 for x in m]) == pytest.approx(0.1, abs=0.03)
    h = 0
    for c in "AL092024":
        h = (h * 1315423911) % 2**32 ^ ord(c)
    assert spark.createDataFrame([("AL092024",)], "n string").select(scenario_seed("n")).first()[0] == h
    ring = spark.range(1).select(circle(F.lit(30.0), F.lit(-80.0), F.lit(111.0)).alias("r")).first().r
    assert len(ring) == 33 and ring[0] == ring[-1] and max(p.y for p in ring) == pytest.approx(31.0)


def test_calibration_edges(spark):
    from perilmesh.operators import calibrate as K

    rows = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0), (1.0, 0.0)], "forecast double, observation double")
    assert sorted((r.bin, r.n) for r in K.reliability(rows, 2).collect()) == [(0, 1), (1, 1)]  # the largest falls off
    assert [(r.bin, r.n) for r in K.histogram(spark.createDataFrame([(1.0,), (0.0,), (1.5,)], "x double"), 4).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 0), (3, 1)]
    few = spark.createDataFrame([(y, 1.0) for y in range(3)], "year int, damage_property double")
    assert K.episode_beta(few, "year").first().status == "INSUFFICIENT"
    four = spark.createDataFrame([(y, float(y)) for y in range(0, 5)], "year int, damage_property double")
    r = K.episode_beta(four, "year", least=4).first()
    assert r.n == 4 and r.beta == pytest.approx((5 / 3) ** 0.5 / 2.5)
    values = spark.createDataFrame([(2000, 1, 5.0), (2000, 6, 7.0)], "year int, month int, value double")
    dates = spark.createDataFrame([(2000, 1), (2000, 5), (2001, 1), (1999, 1)], "year int, month int")
    assert {(r.year, r.month): r.value for r in K.latest_at(values, dates).collect()} == {(2000, 1): 5, (2000, 5): 5, (2001, 1): 7, (1999, 1): None}
    assert K.log_likelihood(spark.createDataFrame([(2, 0.5), (0, 0.0)], "n int, p double")).first().ll == pytest.approx(2 * np.log(0.5))


@pytest.mark.parametrize("values", ([0.0, 120.03, 240.06, 280.07, 360.09, 400.1], [0.0, 2000.0, 520.52] + 63 * [520.5]), ids=("edges", "halves"))
def test_reliability_equals_sql_on_edges_and_halves(spark, tmp_path, values):
    import duckdb

    from perilmesh.plans import registry

    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()["a31_reliability"]).fetchall()
    assert sorted(map(tuple, registry.queries()["a31_reliability"](spark, str(tmp_path)).collect())) == sorted(want)


def test_reliability_without_a_span(spark):
    from perilmesh.operators import calibrate as K

    for forecasts in ([], [2.0, 2.0], [1.0, float("nan")], [None]):
        assert not K.reliability(spark.createDataFrame([(f, 1.0) for f in forecasts], "forecast double, observation double")).collect()
