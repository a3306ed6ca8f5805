"""Areas with holes, and points in boxes, beside plain versions."""

import random

import pytest
from pyspark.sql import functions as F


def _ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def test_areas_with_holes_and_parts(spark):
    from perilmesh.functions import rings as R

    square, hole, triangle = _ring((0, 0), (4, 0), (4, 4), (0, 4)), _ring((1, 1), (1, 3), (3, 3), (3, 1)), _ring((10, 0), (13, 0), (10, 4))
    rows = [("holed", [[square, hole]]), ("parts", [[square, hole], [triangle]]), ("turned", [[square[::-1], hole[::-1]]]), ("none", None), ("line", [[_ring((0, 0), (1, 1))]])]
    areas = spark.createDataFrame(rows, f"name string, area {R.AREA}")
    got = {r["name"]: r for r in areas.select("name", R.moments("area").alias("m"), R.perimeter("area").alias("p"), *(R.in_area(F.lit(x), F.lit(y), "area").alias(c) for c, x, y in (("rim", 0.5, 2.0), ("hole", 2.0, 2.0), ("tri", 10.5, 1.0)))).collect()}
    assert [got["holed"][c] for c in ("rim", "hole", "tri")] == [True, False, False] == [got["turned"][c] for c in ("rim", "hole", "tri")]
    assert [got["parts"][c] for c in ("rim", "hole", "tri")] == [True, False, True] and [got["none"][c] for c in ("rim", "hole", "tri")] == [False] * 3
    assert got["turned"].m.area == pytest.approx(12) == got["holed"].m.area and (got["holed"].m.x, got["holed"].m.y, got["holed"].p) == pytest.approx((2, 2, 24))
    assert got["parts"].m.area == pytest.approx(18) and got["parts"].p == pytest.approx(36)
    assert got["parts"].m.x == pytest.approx((12 * 2 + 6 * 11) / 18) and got["parts"].m.y == pytest.approx((12 * 2 + 6 * 4 / 3) / 18)
    assert got["none"].m.area == 0 and got["line"].m.area == 0 and got["line"].m.x is None


def test_points_in_boxes_of_all_sizes_once(spark):
    from perilmesh.operators.spatial import points_in_boxes

    rng = random.Random(5)
    points = [(i, rng.randrange(-40, 41) / 4, rng.randrange(-40, 41) / 4) for i in range(300)] + [(300, None, 1.0)]
    boxes = []
    for j in range(60):
        x, y, size = rng.randrange(-40, 41) / 4, rng.randrange(-40, 41) / 4, rng.choice([0.0, 0.25, 1.0, 5.0, 22.5, 200.0])
        boxes.append((j, (x, y, x + size, y + size / rng.choice([1, 2]))))
    boxes += [(60, (5.0, 0.0, 1.0, 1.0)), (61, (None, 0.0, 1.0, 1.0))]
    found = points_in_boxes(spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(boxes, "j int, box struct<left:double,low:double,right:double,high:double>"))
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "Cartesian" not in plan
    want = sorted((i, j) for i, x, y in points if x is not None for j, (a, b, c, d) in boxes if a is not None and a <= x <= c and b <= y <= d)
    assert sorted((r.i, r.j) for r in found.collect()) == want and len(want) > 1000
    assert points_in_boxes(spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame([], "j int, box struct<left:double,low:double,right:double,high:double>")).count() == 0


def test_tiles(spark):
    from perilmesh.functions.rings import tile_corner

    rows = spark.createDataFrame([(27.5, -82.4), (-0.5, 0.0), (3.0, 179.9)], "lat double, lon double")
    assert [r.t for r in rows.select(tile_corner("lat", "lon").alias("t")).collect()] == ["N27W084", "S03E000", "N03E177"]


def test_a_hot_decision_is_folded_by_runs(spark):
    from perilmesh.operators.ledger import MOVES, fold_queue

    rng = random.Random(3)
    kinds = ["enqueue", "claim", "cancel", "complete", "fail", "other"]
    moves = [("hot", rng.randrange(-5000, 5000), rng.choice(kinds)) for _ in range(3000)] + [(f"d{i % 40}", rng.randrange(10**12), rng.choice(kinds)) for i in range(200)] + [("quiet", 1, "claim"), ("none", None, "enqueue")]
    want = dict.fromkeys((m[0] for m in moves), "none")
    for d, s, m in sorted((m for m in moves if m[1] is not None), key=lambda m: m[1:]):
        want[d] = MOVES.get((want[d], m), want[d])
    frame = spark.createDataFrame(moves, "decision_id string, seq long, move string")
    for bits in (2, 10):
        assert {r.decision_id: r.state for r in fold_queue(frame, bits).collect()} == want


def test_latest_values_carry_over_blocks(spark):
    from perilmesh.operators.calibrate import latest_at

    rng = random.Random(4)
    values = [(1900 + rng.randrange(120), 1 + rng.randrange(12), rng.choice([None, rng.random()])) for _ in range(60)]
    dates = [(1880 + y, m) for y in range(150) for m in (1, 6, 12)]
    asked = latest_at(spark.createDataFrame(values, "year int, month int, value double"), spark.createDataFrame(dates, "year int, month int"), block=24)
    assert "NestedLoop" not in asked._jdf.queryExecution().toString()
    best = {}
    for y, m, v in values:
        if v is not None:
            best[y * 12 + m] = max(v, best.get(y * 12 + m, v))
    want = {(y, m): next((best[t] for t in sorted(best, reverse=True) if t <= y * 12 + m), None) for y, m in dates}
    got = {(r.year, r.month): r.value for r in asked.collect()}
    assert got == want
