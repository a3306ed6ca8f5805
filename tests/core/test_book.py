import random

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [3, 20_000])
def test_exact_quantiles_equal_numpy(spark, most):
    from perilmesh.operators.cohort import bin_of, exact_quantiles

    rng = random.Random(1)
    values = [rng.choice([rng.lognormvariate(12, 1), 5.0, 7.5]) for _ in range(3000)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    shares = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    got = exact_quantiles(frame, "x", shares, most_values=most)
    assert got == pytest.approx(np.percentile([v for v in values if v is not None], [100 * s for s in shares]).tolist())
    assert exact_quantiles(frame.limit(0), "x", shares) == []
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "x double").select(bin_of("x", [1.5, 2.0])).collect()] == [0, 2, 2]


def test_validation_reports_the_first_failure(spark):
    from perilmesh.operators.ingest import validate

    good = ("1", "fl", "33701", "27.5", "-82.5", "100", "Masonry", "ae")
    bad = [("x", *good[1:]), (*good[:3], "", *good[4:]), (*good[:3], "99", *good[4:]), (*good[:5], "0", *good[6:]), (good[0], "f1", *good[2:]), (*good[:2], "a", *good[3:]), (*good[:6], "straw", good[7]), (*good[:7], "Q"), (None,) * 8]
    rows = validate(spark.createDataFrame([good, *bad], "policy_id string, state string, zip3 string, lat string, lon string, tiv string, build_type string, flood_zone string")).collect()
    assert rows[0].error is None and rows[0].zip3 == "337" and rows[0].flood_zone == "AE"
    words = ["policy_id", "missing", "range", "tiv", "state", "zip3", "build_type", "flood_zone", "policy_id"]
    assert all(w in r.error for w, r in zip(words, rows[1:]))


def test_names_of_personal_data(spark):
    from perilmesh.operators.ingest import classify_columns, suggest_mapping

    private = ["ssn", "SSN", "customer_name", "dob_year", "email_addr", "phone_number", "mailing_address", "custSsnHash"]
    open_ = ["policy_id", "tiv", "zip3", "build_type", "flood_zone", "state", "premium_annual", "business_name", ""]
    got = {r.name: r.is_pii for r in classify_columns(spark.createDataFrame([(n,) for n in private + open_], "name string")).collect()}
    assert got == {n: True for n in private} | {n: False for n in open_}
    best = {r.field: r.name for r in suggest_mapping(spark.createDataFrame([(n,) for n in ("Policy ID", "st", "zip_code", "Latitude", "total_tiv_usd", "customer_name")], "name string")).collect()}
    assert best["policy_id"] == "Policy ID" and best["state"] == "st" and best["zip3"] == "zip_code" and best["lat"] == "Latitude" and best["tiv"] == "total_tiv_usd" and best["county"] is None


def test_points_in_rings(spark):
    from perilmesh.functions.scalars import in_ring

    box = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    rows = [(1.0, 1.0, box), (5.0, 1.0, box), (2.0, 3.0, box), (2.0, 3.0, notch), (0.5, 2.0, notch), (1.0, 1.0, box[:3])]
    frame = spark.createDataFrame([(x, y, [(float(a), float(b)) for a, b in r]) for x, y, r in rows], "px double, py double, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in frame.select(in_ring("px", "py", "ring")).collect()] == [True, False, True, False, True, False]


def test_curves_and_severity(spark):
    from perilmesh.functions import scalars as S

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.wind_damage(F.lit(70.0), F.lit("masonry"))) == 0 and one(S.wind_damage(F.lit(120.0), F.lit("wood_frame"))) == pytest.approx(0.125)
    assert one(S.wind_damage(F.lit(500.0), F.lit("unknown"))) == 0.85
    for peril, level, number, want in (("earthquake", None, 5.5, 0.0), ("earthquake", None, 8.0, 1.45), ("hail", None, 45.0, 1.0), ("hail", "severe", None, 1.0), ("flood", "moderate", None, 0.70), ("tornado", "catastrophic", None, 1.45), ("winter", "what", None, 1.0)):
        assert one(S.damage_multiplier(F.lit(peril), F.lit(level), F.lit(number).cast("double"))) == pytest.approx(want)
    assert one(S.damage_ratio(F.lit("hail"), F.lit("straw"), F.lit(1.0))) == 0 and one(S.damage_ratio(F.lit("wildfire"), F.lit("masonry"), F.lit(9.0))) == 1
    assert [one(S.damage_dollars(F.lit(x))) for x in ("2.5K", "3m", "1B", "7", "", "x")] == [2500, 3e6, 1e9, 7, None, None]
    assert one(S.retained_xs(F.lit(5.0), F.lit(2.0), F.lit(4.0))) == 3 and one(S.ceded_xs(F.lit(5.0), F.lit(2.0), F.lit(4.0))) == 2
