"""Queries on scenario losses, tails, footprints and treaties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import cohort as C
from ..operators import loss as L
from .domain import BOOK, COHORTED, COHORTS, oracle, policies, table

QUERIES: dict = {}
DRAWS = 1000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def lcg_sql(key: str, rounds: int = 3) -> str:
    for _ in range(rounds):
        key = f"(({key}) * 1103515245 + 12345) % 2147483648"
    return f"(({key})::DOUBLE / 2147483648)"


def normal_sql(key: str) -> str:
    return f"round(sqrt(-2 * ln(greatest({lcg_sql(f'({key}) * 2 + 1')}, 1e-9::DOUBLE))) * cos(2 * 3.141592653589793::DOUBLE * {lcg_sql(f'({key}) * 2 + 2')}), 9)"


_NUMBER = "((zip3::BIGINT * 10 + CASE build_type WHEN 'wood_frame' THEN 0 WHEN 'masonry' THEN 1 ELSE 2 END) * 10 + tiv_quintile)"
PRIOR_SQL = f"losses AS (SELECT cohort_id, k, round(loss_p50 * exp({X.PRIOR_SIGMA}::DOUBLE * {normal_sql(f'({_NUMBER} * 10) * 1000 + k')}), 2) AS loss FROM cohorts, (SELECT unnest(range({DRAWS})) AS k))"
TAILS_SQL = """tails AS (SELECT l.cohort_id, any_value(p50) AS p50, any_value(p99) AS p99, sum(loss::DECIMAL(18,4))::DOUBLE / count(*) AS tvar
  FROM losses l JOIN (SELECT cohort_id, quantile_cont(loss, 0.5) AS p50, quantile_cont(loss, 0.99) AS p99 FROM losses GROUP BY cohort_id) q ON l.cohort_id = q.cohort_id AND l.loss >= q.p99 GROUP BY l.cohort_id)"""
BOOKLOSS_SQL = "book AS (SELECT k, sum(loss::DECIMAL(18,4))::DOUBLE AS loss FROM losses GROUP BY k)"
LOSSES = (*COHORTS, PRIOR_SQL)


def _cohorts(spark, d):
    return C.cohorts(C.binned(policies(spark, d)))


def _losses(spark, d):
    return L.prior_losses(_cohorts(spark, d), DRAWS)


@query(oracle(*LOSSES, "SELECT cohort_id, k, loss FROM losses"))
def r4_prior_losses(spark, d):
    return _losses(spark, d)


@query(oracle(*LOSSES, TAILS_SQL, "SELECT cohort_id, round(p50, 5) AS p50, round(p99, 5) AS p99, round(tvar, 5) AS tvar FROM tails"))
def a12_cohort_tails(spark, d):
    out = L.tails(_losses(spark, d))
    return out.select("cohort_id", *(F.round(c, 5).alias(c) for c in ("p50", "p99", "tvar")))


@query(oracle(*LOSSES, BOOKLOSS_SQL, "SELECT round((SELECT quantile_cont(loss, 0.5) FROM book), 4) AS p50, round(q, 4) AS p99, round(sum(loss::DECIMAL(18,4))::DOUBLE / count(*), 4) AS tvar FROM book, (SELECT quantile_cont(loss, 0.99) AS q FROM book) WHERE loss >= q GROUP BY q"))
def a13_book_tails(spark, d):
    return L.tails(L.book_losses(_losses(spark, d))).select(*(F.round(c, 4).alias(c) for c in ("p50", "p99", "tvar")))


@query(oracle(*LOSSES, TAILS_SQL, "SELECT round(sum(p99::DECIMAL(18,4))::DOUBLE, 2) AS sum_p99, round(sum(tvar::DECIMAL(18,4))::DOUBLE, 2) AS sum_tvar, round(0.4::DOUBLE * sum(p99::DECIMAL(18,4))::DOUBLE, 2) AS capital_budget FROM (SELECT round(p99, 2) AS p99, round(tvar, 2) AS tvar FROM tails)"))
def a14_gross_tails(spark, d):
    t = L.tails(_losses(spark, d)).select(F.round("p99", 2).alias("p99"), F.round("tvar", 2).alias("tvar"))
    p = S.money_sum("p99")
    return t.agg(F.round(p, 2).alias("sum_p99"), F.round(S.money_sum("tvar"), 2).alias("sum_tvar"), F.round(0.4 * p, 2).alias("capital_budget"))


@query(oracle(*LOSSES, BOOKLOSS_SQL, f"SELECT round(sum(loss::DECIMAL(18,4))::DOUBLE / {DRAWS // 100}, 4) AS tvar FROM (SELECT loss FROM book ORDER BY loss DESC, k LIMIT {DRAWS // 100})"))
def a15_joint_tail(spark, d):
    return L.top_mean(L.book_losses(_losses(spark, d)), DRAWS).select(F.round("tvar", 4).alias("tvar"))


_AAL = "CASE peril " + " ".join(f"WHEN '{p}' THEN total_tiv * (CASE state " + " ".join(f"WHEN '{s}' THEN {v!r}::DOUBLE" for s, v in r.items() if s != "default") + f" ELSE {r['default']!r}::DOUBLE END) * (CASE build_type " + " ".join(f"WHEN '{b}' THEN {v!r}::DOUBLE" for b, v in X.AAL_VULNERABILITY[p].items()) + " ELSE 1 END)" for p, r in X.AAL_RATE.items()) + " END"
_SIGMA = "CASE peril " + " ".join(f"WHEN '{p}' THEN {s!r}::DOUBLE" for p, s in X.AAL_SIGMA.items()) + " END"
_PERILS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(X.AAL_RATE))
OVERLAY_SQL = f"""overlay AS (SELECT cohort_id, peril, k, round(exp(ln(aal) - s * s / 2 + s * z), 2) AS loss FROM (
  SELECT cohort_id, peril, k, {_AAL} AS aal, {_SIGMA} AS s, {normal_sql(f"({_NUMBER} * 10 + stream + 1) * 1000 + k")} AS z FROM cohorts, (VALUES {_PERILS}) p(stream, peril), (SELECT unnest(range({DRAWS})) AS k)))"""


@query(oracle(*COHORTS, OVERLAY_SQL, "SELECT peril, k, round(sum(loss::DECIMAL(18,4))::DOUBLE, 2) AS loss FROM overlay GROUP BY peril, k"))
def r5_peril_overlay(spark, d):
    return L.peril_overlay(_cohorts(spark, d), DRAWS).groupBy("peril", "k").agg(F.round(S.money_sum("loss"), 2).alias("loss"))


@query(oracle(*LOSSES, f"SELECT cohort_id, k, round(loss * (1 + 0.3::DOUBLE * {normal_sql('k + 77')}), 2) AS loss FROM losses"))
def r6_common_factor(spark, d):
    return L.common_factor(_losses(spark, d), 0.3)


# each draw moves every vertex of a box, and scales all its losses by one common factor
_BOX = (-84.0, 26.0, -80.0, 29.5)
_VERTICES = ((_BOX[0], _BOX[1]), (_BOX[2], _BOX[1]), (_BOX[2], _BOX[3]), (_BOX[0], _BOX[3]))
RINGS_SQL = "rings AS (SELECT k, " + ", ".join(f"{a}::DOUBLE + 0.05::DOUBLE * {normal_sql(f'k * 8 + {5000 + 2 * i}')} AS x{i}, {b}::DOUBLE + 0.05::DOUBLE * {normal_sql(f'k * 8 + {5001 + 2 * i}')} AS y{i}" for i, (a, b) in enumerate(_VERTICES)) + f", greatest(0::DOUBLE, 1 + 0.3::DOUBLE * {normal_sql('k + 77')}) AS factor FROM (SELECT unnest(range({DRAWS})) AS k))"
_INSIDE = "(" + " + ".join(f"((y{i} > lat) <> (y{j} > lat) AND lon < (x{j} - x{i}) * (lat - y{i}) / (y{j} - y{i} + 1e-15::DOUBLE) + x{i})::INT" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0))) + ") % 2 = 1"


def _rings(spark, draws=DRAWS):
    k = F.col("k")
    at = [F.struct((F.lit(a) + 0.05 * S.normal(k * 8 + 5000 + 2 * i)).alias("x"), (F.lit(b) + 0.05 * S.normal(k * 8 + 5001 + 2 * i)).alias("y")) for i, (a, b) in enumerate(_VERTICES)]
    return spark.range(draws).select(F.col("id").alias("k")).select("k", F.array(*at, at[0]).alias("ring"), F.greatest(F.lit(0.0), 1 + 0.3 * S.normal(k + 77)).alias("factor"))


_HAIL = "CASE build_type WHEN 'wood_frame' THEN 0.18::DOUBLE WHEN 'masonry' THEN 0.1::DOUBLE WHEN 'manufactured' THEN 0.32::DOUBLE WHEN 'commercial' THEN 0.12::DOUBLE ELSE 0 END"


@query(oracle(*COHORTED, RINGS_SQL, f"SELECT cohort_id, k, round(sum((tiv * least(1::DOUBLE, greatest(0::DOUBLE, {_HAIL} * 1.8::DOUBLE)))::DECIMAL(18,4))::DOUBLE * any_value(factor), 2) AS loss FROM (SELECT * FROM binned WHERE lon > {_BOX[0] - 1} AND lon < {_BOX[2] + 1} AND lat > {_BOX[1] - 1} AND lat < {_BOX[3] + 1}), rings WHERE {_INSIDE} GROUP BY cohort_id, k"))
def r7_footprint_losses(spark, d):
    return L.footprint_losses(C.binned(policies(spark, d)), _rings(spark), "hail", 1.8)


@query(oracle(*BOOK, f"""SELECT zip3 || '_' || build_type AS grp, count(*) AS n, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv, sum((tiv * {_HAIL})::DECIMAL(18,4))::DOUBLE AS loss
 FROM policies WHERE lon > {_BOX[0]} AND lon < {_BOX[2]} AND lat > {_BOX[1]} AND lat < {_BOX[3]} GROUP BY 1 ORDER BY loss DESC, grp LIMIT 5"""))
def a23_preview_impact(spark, d):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((_BOX[0], _BOX[1]), (_BOX[2], _BOX[1]), (_BOX[2], _BOX[3]), (_BOX[0], _BOX[3]), (_BOX[0], _BOX[1]))))
    box = F.col("lon").between(_BOX[0], _BOX[2]) & F.col("lat").between(_BOX[1], _BOX[3])
    inside = policies(spark, d).where(box & S.in_ring("lon", "lat", ring))
    loss = F.col("tiv") * S.damage_ratio(F.lit("hail"), "build_type", F.lit(1.0))
    out = inside.groupBy(F.concat_ws("_", "zip3", "build_type").alias("grp")).agg(F.count("*").alias("n"), S.money_sum("tiv").alias("tiv"), S.money_sum(loss).alias("loss"))
    return out.orderBy(F.desc("loss"), "grp").limit(5)


@query(oracle(*BOOK, f"""SELECT CASE WHEN lat IS NULL THEN 'unmapped' WHEN lon >= {_BOX[0]} AND lon < {_BOX[2]} AND lat >= {_BOX[1]} AND lat < {_BOX[3]} THEN 'inside' ELSE 'outside' END AS place, count(*) AS n, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv
 FROM (SELECT CASE WHEN id % 20 <> 0 THEN lat END AS lat, lon, tiv FROM policies) GROUP BY 1"""))
def a24_cone_exposure(spark, d):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((_BOX[0], _BOX[1]), (_BOX[2], _BOX[1]), (_BOX[2], _BOX[3]), (_BOX[0], _BOX[3]), (_BOX[0], _BOX[1]))))
    rows = policies(spark, d).withColumn("lat", F.when(F.col("id") % 20 != 0, F.col("lat")))
    place = F.when(F.col("lat").isNull(), "unmapped").when(S.in_ring("lon", "lat", ring), "inside").otherwise("outside")
    return rows.groupBy(place.alias("place")).agg(F.count("*").alias("n"), S.money_sum("tiv").alias("tiv"))


def _hav_sql(a, b, c, d_, r="6371"):
    return f"2 * {r} * asin(least(1::DOUBLE, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d_}) - radians({b})) / 2), 2))))"


@query(oracle(*BOOK, f"SELECT id, round({_hav_sql('lat', 'lon', '27.95', '(-82.46)')}, 6) AS km, round({_hav_sql('lat', 'lon', '27.95', '(-82.46)', '3958.7613')} / 50, 4) AS hours FROM policies"))
def f1_distances(spark, d):
    return policies(spark, d).select("id", F.round(S.haversine("lat", "lon", F.lit(27.95), F.lit(-82.46)), 6).alias("km"), F.round(S.drive_hours("lat", "lon", F.lit(27.95), F.lit(-82.46)), 4).alias("hours"))


_TRACK = [(24.0 + 0.5 * i, -83.0 + 0.1 * i) for i in range(8)]


@query(oracle(*BOOK, "SELECT id, round(least(" + ", ".join(_hav_sql("lat", "lon", str(a), f"({b})") for a, b in _TRACK) + "), 6) AS km FROM policies"))
def j12_nearest_track(spark, d):
    return policies(spark, d).select("id", F.round(F.least(*(S.haversine("lat", "lon", F.lit(a), F.lit(b)) for a, b in _TRACK)), 6).alias("km"))


def _curve_sql(x, points):
    out = f"CASE WHEN {x} <= {points[0][0]} THEN {float(points[0][1])}::DOUBLE "
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f"WHEN {x} <= {x1} THEN {float(y0)}::DOUBLE + ({x} - {x0}) * {float(y1 - y0) / float(x1 - x0)!r}::DOUBLE "
    return out + f"ELSE {float(points[-1][1])}::DOUBLE END"


@query(oracle(*BOOK, "SELECT id, round(CASE build_type WHEN 'masonry' THEN " + _curve_sql("w", X.WIND_CURVE["masonry"]) + " WHEN 'manufactured' THEN " + _curve_sql("w", X.WIND_CURVE["manufactured"]) + " ELSE " + _curve_sql("w", X.WIND_CURVE["wood_frame"]) + " END, 9) AS wind, round(" + _curve_sql("f", X.SURGE_CURVE) + ", 9) AS surge FROM (SELECT id, build_type, (60 + id % 140)::DOUBLE AS w, greatest((id % 60)::DOUBLE / 10 - coalesce(elevation_m, 0), 0::DOUBLE) AS f FROM policies)"))
def f4_damage_curves(spark, d):
    return policies(spark, d).select("id", F.round(S.wind_damage((60 + F.col("id") % 140).cast("double"), "build_type"), 9).alias("wind"), F.round(S.surge_damage((F.col("id") % 60) / F.lit(10.0), F.coalesce("elevation_m", F.lit(0.0))), 9).alias("surge"))


_MULT = "CASE WHEN peril = 'earthquake' AND number IS NOT NULL THEN CASE WHEN number < 5.53 THEN 0::DOUBLE ELSE 1 + 0.45::DOUBLE * (number - 7) END WHEN peril = 'hail' AND number IS NOT NULL THEN greatest(0::DOUBLE, 0.04::DOUBLE * (number - 20)) " + " ".join(f"WHEN peril = '{p}' THEN CASE level " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in {**X.INTENSITY, **lv}.items()) + " ELSE 1::DOUBLE END" for p, lv in X.LEVELS.items()) + " ELSE CASE level WHEN 'moderate' THEN 0.55::DOUBLE WHEN 'severe' THEN 1::DOUBLE WHEN 'catastrophic' THEN 1.45::DOUBLE ELSE 1::DOUBLE END END"
_BASE = "CASE build_type " + " ".join(f"WHEN '{b}' THEN CASE peril " + " ".join(f"WHEN '{p}' THEN {v!r}::DOUBLE" for p, v in row.items()) + " END" for b, row in X.DAMAGE.items()) + " ELSE 0::DOUBLE END"
_LEVELS = ("ef0", "ef3", "major", "moderate", "high", "extreme", "severe", "catastrophic", "none", "minor", "limited")


@query(oracle(f"footprints AS (SELECT p_partkey AS n, (ARRAY{list(X.PERILS)})[p_partkey % 6 + 1] AS peril, (ARRAY{list(_LEVELS)})[p_partkey % 11 + 1] AS level, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 6 = 4 THEN 5 + (p_partkey % 40)::DOUBLE / 10 ELSE (p_partkey % 110)::DOUBLE END END AS number, (ARRAY['wood_frame', 'masonry', 'manufactured', 'commercial', 'straw'])[p_partkey % 5 + 1] AS build_type FROM part)",
    f"SELECT n, round(m, 9) AS multiplier, round(least(1::DOUBLE, greatest(0::DOUBLE, {_BASE} * m)), 9) AS ratio, CASE WHEN m < 0.775 THEN 'moderate' WHEN m < 1.225 THEN 'severe' ELSE 'catastrophic' END AS tier FROM (SELECT *, {_MULT} AS m FROM footprints)"))
def f7_damage_ratios(spark, d):
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    rows = table(spark, d, "part").select(k.alias("n"), pick(X.PERILS, 6).alias("peril"), pick(_LEVELS, 11).alias("level"), F.when(k % 5 != 0, F.when(k % 6 == 4, 5 + (k % 40) / F.lit(10.0)).otherwise((k % 110).cast("double"))).alias("number"), pick(("wood_frame", "masonry", "manufactured", "commercial", "straw"), 5).alias("build_type"))
    rows = rows.withColumn("m", S.damage_multiplier("peril", "level", "number"))
    return rows.select("n", F.round("m", 9).alias("multiplier"), F.round(S.damage_ratio("peril", "build_type", "m"), 9).alias("ratio"), S.legacy_tier("m").alias("tier"))


@query("SELECT n, round(CASE WHEN peril = 'tornado' THEN exp(-d / (w / 2)) WHEN peril = 'hail' THEN CASE WHEN d <= w THEN 1 ELSE 0.6::DOUBLE * exp(-(d - w) / w) END WHEN peril = 'earthquake' THEN greatest(0::DOUBLE, 1 - d / greatest(1::DOUBLE, w)) ELSE 1 END, 9) AS decay, round(greatest(0::DOUBLE, (1.68::DOUBLE * m - 3.29 - 6) / 0.0206), 6) AS mmi6_km FROM (SELECT p_partkey AS n, ['tornado', 'hail', 'earthquake', 'flood'][p_partkey % 4 + 1] AS peril, (p_partkey % 30)::DOUBLE AS d, (1 + p_partkey % 7)::DOUBLE AS w, 4 + (p_partkey % 45)::DOUBLE / 10 AS m FROM part)")
def f10_peril_decay(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("n"), F.element_at(F.array(*map(F.lit, ("tornado", "hail", "earthquake", "flood"))), (k % 4 + 1).cast("int")).alias("peril"), (k % 30).cast("double").alias("d"), (1 + k % 7).cast("double").alias("w"), (4 + (k % 45) / F.lit(10.0)).alias("m"))
    return rows.select("n", F.round(S.peril_decay("peril", "d", "w"), 9).alias("decay"), F.round(S.mmi_radius_km("m", F.lit(6.0)), 6).alias("mmi6_km"))


@query(oracle(*BOOK, "SELECT id, round(greatest(0::DOUBLE, 4 * pow(w / 140, 2) * exp(-k / 30) - 0.25::DOUBLE * e), 6) AS raw_depth, round(w * exp(-k / 80.5::DOUBLE), 6) AS wind FROM (SELECT id, (80 + id % 100)::DOUBLE AS w, (id % 120)::DOUBLE AS k, coalesce(elevation_m, 0) AS e FROM policies)"))
def f3_surge_and_wind(spark, d):
    w, k, e = (80 + F.col("id") % 100).cast("double"), (F.col("id") % 120).cast("double"), F.coalesce("elevation_m", F.lit(0.0))
    raw = F.greatest(F.lit(0.0), 4 * F.pow(w / 140, 2) * F.exp(-k / 30) - 0.25 * e)
    return policies(spark, d).select("id", F.round(raw, 6).alias("raw_depth"), F.round(S.wind_at_property(w, k), 6).alias("wind"))


@query(oracle("""quads AS (SELECT c_custkey AS n, least(511, greatest(0, floor((lon + 180) / 360 * 512)))::INT AS x, least(511, greatest(0, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793::DOUBLE)) * 512)))::INT AS y
 FROM (SELECT c_custkey, 24 + (c_custkey * 7 % 1200)::DOUBLE / 100 AS lat, -98 + (c_custkey * 13 % 2000)::DOUBLE / 100 AS lon FROM customer))""",
    "SELECT n, " + " || ".join(f"((x >> {z}) % 2 + 2 * ((y >> {z}) % 2))::VARCHAR" for z in range(8, -1, -1)) + " AS quadkey FROM quads"))
def f16_quadkeys(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("n"), S.quadkey(24 + (k * 7 % 1200) / F.lit(100.0), -98 + (k * 13 % 2000) / F.lit(100.0)).alias("quadkey"))


@query("SELECT n, round(least(l, a) + greatest(0::DOUBLE, l - e), 4) AS retained, round(greatest(0::DOUBLE, least(l, e) - a), 4) AS ceded FROM (SELECT o_orderkey AS n, o_totalprice AS l, 100000::DOUBLE AS a, CASE WHEN o_orderkey % 9 = 0 THEN 100000::DOUBLE ELSE 300000::DOUBLE END AS e FROM orders)")
def f18_layers(spark, d):
    a, e = F.lit(100000.0), F.when(F.col("o_orderkey") % 9 == 0, 100000.0).otherwise(300000.0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.round(S.retained_xs("o_totalprice", a, e), 4).alias("retained"), F.round(S.ceded_xs("o_totalprice", a, e), 4).alias("ceded"))


@query(oracle("u AS (SELECT o_custkey % 50 AS layer, o_orderkey AS event_id, o_totalprice AS loss, greatest(0::DOUBLE, least(o_totalprice, 60000::DOUBLE) - 20000) AS x FROM orders)",
    "c AS (SELECT *, (sum(x::DECIMAL(18,4)) OVER (PARTITION BY layer ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS cum FROM u)", "SELECT layer, event_id, loss, round(least(120000::DOUBLE, cum) - least(120000::DOUBLE, cum - x), 2) AS ceded FROM c"))
def f20_layer_capacity(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("layer"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("loss"))
    return L.layer_capacity(rows, 20000.0, 60000.0, 2)


@query("SELECT n, action, round(f, 9) AS factor FROM (SELECT n_nationkey AS n, action, CASE WHEN c IS NULL THEN CASE action WHEN 'non_renew' THEN 0::DOUBLE WHEN 'cede_qs' THEN 0.5::DOUBLE ELSE 1::DOUBLE END ELSE (1 + c) * (1 - (n_nationkey % 10)::DOUBLE / 10 * greatest(c, 0::DOUBLE)) END AS f FROM nation, (VALUES " + ", ".join(f"('{a}', {X.RATE_CHANGE[a]!r}::DOUBLE)" if a in X.RATE_CHANGE else f"('{a}', NULL)" for a in X.ACTIONS) + ") a(action, c))")
def f17_reprice_factors(spark, d):
    acts = spark.createDataFrame([(a, X.RATE_CHANGE.get(a)) for a in X.ACTIONS], "action string, c double")
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("n")).join(F.broadcast(acts))
    plain = S.case_of("action", {"non_renew": 0.0, "cede_qs": 0.5}, 1.0)
    eta = (F.col("n") % 10) / F.lit(10.0)
    factor = F.when(F.col("c").isNull(), plain).otherwise((1 + F.col("c")) * (1 - eta * F.greatest(F.col("c"), F.lit(0.0))))
    return rows.select("n", "action", F.round(factor, 9).alias("factor"))


@query(oracle(*LOSSES, "sim AS (SELECT cohort_id, k + 1000 AS k, loss * 2 AS loss FROM losses WHERE k < 10 AND (k + length(cohort_id)) % 2 = 0)", "SELECT cohort_id, count(*) AS draws, sum(loss::DECIMAL(18,4))::DOUBLE AS loss FROM (SELECT * FROM losses UNION ALL SELECT * FROM sim) GROUP BY cohort_id"))
def j13_merged_sims(spark, d):
    prior = _losses(spark, d)
    sim = prior.where("k < 10 AND (k + length(cohort_id)) % 2 = 0").withColumn("loss", F.col("loss") * 2)
    return L.merged(prior, sim, 1000).groupBy("cohort_id").agg(F.count("*").alias("draws"), S.money_sum("loss").alias("loss"))
