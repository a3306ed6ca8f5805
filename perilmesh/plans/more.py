"""Queries on peril generators, geometry and ex-post evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as V
from ..operators import loss as L
from ..operators import perils as P
from ..operators import portfolio as Q
from .decide import _CEDED, _LOSS, _PREM, ACTED, DOMINANT_SQL, _actions, _cohorts
from .domain import BOOK, anchors, oracle, policies, table
from .loss import DRAWS, PRIOR_SQL, lcg_sql, normal_sql

QUERIES: dict = {}
N = 2000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


_K = f"(SELECT unnest(range({N})) AS k)"
_U = [lcg_sql(f"(k + 1) * 8 + {i}") for i in range(4)]


def _pick(u: str, options: list[tuple]) -> str:
    at, out = 0.0, "CASE "
    for name, weight, *_ in options[:-1]:
        at += weight
        out += f"WHEN {u} < {round(at, 9)!r}::DOUBLE THEN '{name}' "
    return out + f"ELSE '{options[-1][0]}' END"


def _side(regions: list[tuple], j: int) -> str:
    return "CASE region " + " ".join(f"WHEN '{n}' THEN {b[j]!r}::DOUBLE" for n, _, b in regions) + " END"


def _in(u: str, low, high) -> str:
    return f"round({low} + ({high} - {low}) * {u}, 4)"


_B = P.HAIL_BOX
_CLASS = _pick("u0", [(str(i), w) for i, (_, _, w) in enumerate(P.STONES)])


@query(oracle(f"h AS (SELECT k, {_U[0]} AS u0, {_U[1]} AS u1, {_U[2]} AS u2, {_U[3]} AS u3 FROM {_K})", f"c AS (SELECT *, ({_CLASS})::INT AS i FROM h)",
    f"SELECT k, round([{', '.join(f'{s[0]!r}::DOUBLE' for s in P.STONES)}][i + 1] + ([{', '.join(f'{s[1]!r}::DOUBLE' for s in P.STONES)}][i + 1] - [{', '.join(f'{s[0]!r}::DOUBLE' for s in P.STONES)}][i + 1]) * u1, 0) AS diameter_mm, {_in('u2', '28.0::DOUBLE', '47.0::DOUBLE')} AS lat, {_in('u3', '-105.0::DOUBLE', '-86.0::DOUBLE')} AS lon FROM c"))
def r3_hail(spark, d):
    return P.hail(spark, N)


_SPAN = 1 - 10 ** (-P.GR_B * (P.MAGNITUDE[1] - P.MAGNITUDE[0]))


@query(oracle(f"e AS (SELECT k, {_pick(_U[0], P.SEISMIC)} AS region, round({P.MAGNITUDE[0]}::DOUBLE - log10(1 - {_U[1]} * {_SPAN!r}::DOUBLE) / {P.GR_B}::DOUBLE, 2) AS magnitude, {_U[2]} AS u2, {_U[3]} AS u3 FROM {_K})",
    f"SELECT k, region, magnitude, {_in('u2', _side(P.SEISMIC, 0), _side(P.SEISMIC, 1))} AS lat, {_in('u3', _side(P.SEISMIC, 2), _side(P.SEISMIC, 3))} AS lon, round(greatest(0::DOUBLE, (1.68::DOUBLE * magnitude - 3.29 - 6) / 0.0206), 2) AS mmi6_km FROM e"))
def r3_earthquakes(spark, d):
    return P.earthquakes(spark, N)


@query(oracle(f"SELECT k, {_pick(_U[0], P.FIRES)} AS severity, round(greatest(300::DOUBLE, least(1000000::DOUBLE, 2000::DOUBLE * exp(1.6::DOUBLE * {normal_sql('(k + 1) * 8 + 1')}))), 2) AS acres, {_in(_U[2], '31.0::DOUBLE', '49.0::DOUBLE')} AS lat, {_in(_U[3], '-124.0::DOUBLE', '-103.0::DOUBLE')} AS lon FROM {_K}"))
def r3_wildfires(spark, d):
    return P.wildfires(spark, N)


@query(oracle(f"f AS (SELECT k, {_pick(_U[0], P.WINTER)} AS severity, {_pick(_U[1], P.WINTER_REGIONS)} AS region, {_U[2]} AS u2, {_U[3]} AS u3 FROM {_K})", f"SELECT k, severity, region, {_in('u2', _side(P.WINTER_REGIONS, 0), _side(P.WINTER_REGIONS, 1))} AS lat, {_in('u3', _side(P.WINTER_REGIONS, 2), _side(P.WINTER_REGIONS, 3))} AS lon FROM f"))
def r3_freezes(spark, d):
    return P.freezes(spark, N)


_T = [(6.0 * i, 24.0 + 0.5 * i, -83.0 + 0.1 * i) for i in range(21)]
_KM = "((1.2::DOUBLE * hours + 20) * 1.852 * 0.6715597::DOUBLE)"


@query(oracle("track(hours, lat, lon) AS (VALUES " + ", ".join(f"({h}::DOUBLE, {a!r}::DOUBLE, {o!r}::DOUBLE)" for h, a, o in _T) + ")",
    f"SELECT k, hours, round(lat + {_KM} / 111 * {normal_sql('(k * 1000 + hours::BIGINT) * 2')}, 6) AS lat, round(lon + {_KM} / 111 / greatest(0.1::DOUBLE, cos(radians(lat))) * {normal_sql('(k * 1000 + hours::BIGINT) * 2 + 1')}, 6) AS lon FROM track, (SELECT unnest(range(200)) AS k)"))
def r1_perturbed_tracks(spark, d):
    return P.perturbed_tracks(spark.createDataFrame(_T, "hours double, lat double, lon double"), 200)


@query(None)
def f33_scenario_seeds(spark, d):
    return table(spark, d, "nation").select("n_name", P.scenario_seed("n_name").alias("seed"))


@query(None)
def f13_hulls(spark, d):
    return P.convex_hulls(policies(spark, d).select("state", "lon", "lat"), "state")


@query("SELECT r_regionkey AS n, round(least(1::DOUBLE, greatest(0::DOUBLE, 4 * 3.141592653589793::DOUBLE * a / (p * p))), 9) AS compactness FROM (SELECT r_regionkey, (1 + r_regionkey)::DOUBLE AS a, (4 + r_regionkey * 3)::DOUBLE AS p FROM region)")
def a42_compactness(spark, d):
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(k.alias("n"), F.round(P.polsby_popper((1 + k).cast("double"), (4 + k * 3).cast("double")), 9).alias("compactness"))


REALISED_SQL = "realised AS (SELECT cohort_id, round(loss_p50 * (policy_count % 4), 4) AS realised FROM cohorts WHERE policy_count % 3 <> 0)"


@query(oracle(*ACTED, REALISED_SQL, f"m AS (SELECT cohort_id, any_value(total_premium) AS prem, sum(share * {_PREM}) AS p, sum(share * {_LOSS}) AS l, sum(share * {_CEDED}) AS c FROM acts GROUP BY cohort_id)",
    "t AS (SELECT round(sum((prem * p)::DECIMAL(18,6))::DOUBLE, 2) AS premium_collected, round(sum((coalesce(realised, 0) * l)::DECIMAL(18,6))::DOUBLE, 2) AS loss_paid, round(sum((prem * c)::DECIMAL(18,6))::DOUBLE, 2) AS cession_cost FROM m LEFT JOIN realised USING (cohort_id))", "SELECT *, round(premium_collected - loss_paid - cession_cost, 2) AS net_pnl FROM t"))
def a38_profit_and_loss(spark, d):
    c = _cohorts(spark, d)
    realised = c.where("policy_count % 3 <> 0").select("cohort_id", F.round(F.col("loss_p50") * (F.col("policy_count") % 4), 4).alias("realised"))
    return V.profit_and_loss(_actions(c), c, realised)


@query(oracle(*ACTED, DOMINANT_SQL, PRIOR_SQL, f"""kept AS (SELECT k, sum((CASE WHEN action = 'cede_xs' THEN least(loss, 1.5::DOUBLE * loss_p50) + greatest(0::DOUBLE, loss - greatest(2::DOUBLE * (loss_p50 * 7.2::DOUBLE), 1.5::DOUBLE * loss_p50)) ELSE loss * {_LOSS} END)::DECIMAL(18,4))::DOUBLE AS loss
  FROM losses JOIN (SELECT dom.cohort_id, dom.action, c.loss_p50 FROM dom JOIN cohorts c USING (cohort_id)) USING (cohort_id) GROUP BY k)""", "SELECT k, round(loss, 4) AS loss FROM kept"))
def a16_retained_losses(spark, d):
    c = _cohorts(spark, d).withColumn("loss_p99", F.col("loss_p50") * 7.2)
    return V.retained_losses(L.prior_losses(c, DRAWS), _actions(c), c).select("k", F.round("loss", 4).alias("loss"))


@query(oracle(*ACTED, f"SELECT 'd' || tiv_quintile AS decision_id, tiv_quintile % 2 = 1 AS drifted, round(sum((share * {_LOSS} * CASE WHEN policy_count % 7 <> 0 THEN loss_p50 ELSE 0 END)::DECIMAL(18,4))::DOUBLE, 2) AS retained, count(DISTINCT cohort_id) FILTER (WHERE policy_count % 7 = 0) AS missing FROM (SELECT a.cohort_id, a.action, a.share, c.loss_p50, c.policy_count, c.tiv_quintile FROM acts a JOIN cohorts c USING (cohort_id)) GROUP BY 1, 2"))
def a39_decision_drift(spark, d):
    c = _cohorts(spark, d)
    rows = _actions(c).join(c.select("cohort_id", "tiv_quintile"), "cohort_id")
    decisions = rows.groupBy("tiv_quintile").agg(F.collect_list(F.struct("cohort_id", "action", "share")).alias("actions")).select(
        F.concat(F.lit("d"), F.col("tiv_quintile").cast("string")).alias("decision_id"), F.lit("x").alias("cohorts_hash"), F.when(F.col("tiv_quintile") % 2 == 1, "y").otherwise("x").alias("now_hash"), "actions")
    return V.decision_drift(decisions, c.where("policy_count % 7 <> 0")).withColumn("missing", F.col("missing").cast("long"))


@query(None)
def f32_crps(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("y"), F.array(F.lit(50_000.0), F.lit(150_000.0), F.lit(300_000.0)).alias("q"))
    return V.crps(rows, [0.1, 0.5, 0.9]).select("n", F.round("crps", 4).alias("crps"))


def _staff(spark, d):
    k = F.col("s_suppkey")
    a = anchors(spark).select("i", "alat", "alon")
    adjusters = table(spark, d, "supplier").join(a, k % 38 == F.col("i")).select(k.alias("adjuster_id"), F.col("alat").alias("home_lat"), F.col("alon").alias("home_lon"), F.when(k % 3 == 0, F.array(F.lit("flood"), F.lit("wind"))).when(k % 3 == 1, F.array(F.lit("wind"))).otherwise(F.array().cast("array<string>")).alias("skills"))
    z = F.col("n_nationkey")
    zones = table(spark, d, "nation").join(a, z == F.col("i")).select(z.alias("zone_id"), F.col("alat").alias("lat"), F.col("alon").alias("lon"), (1 + z % 3).alias("capacity"), F.when(z % 4 == 0, "flood").when(z % 4 == 1, "wind").alias("required_skill"), (10 + z % 7).cast("double").alias("expected_claim_volume"))
    return adjusters, zones


@query(oracle(BOOK[0], """pairs AS (SELECT s_suppkey AS adjuster_id, n_nationkey AS zone_id, round(2 * 3958.7613 * asin(least(1::DOUBLE, sqrt(pow(sin((radians(z.alat) - radians(h.alat)) / 2), 2) + cos(radians(h.alat)) * cos(radians(z.alat)) * pow(sin((radians(z.alon) - radians(h.alon)) / 2), 2)))) / 50, 4) AS hours
  FROM supplier JOIN anchors h ON h.i = s_suppkey % 38, nation JOIN anchors z ON z.i = n_nationkey WHERE n_nationkey % 4 > 1 OR (n_nationkey % 4 = 0 AND s_suppkey % 3 = 0) OR (n_nationkey % 4 = 1 AND s_suppkey % 3 < 2))""", "SELECT * FROM pairs WHERE hours <= 8"))
def j10_feasible_assignments(spark, d):
    return V.feasible_assignments(*_staff(spark, d)).select("adjuster_id", "zone_id", "hours")


@query(None)
def o6_assignments(spark, d):
    return V.assign(*_staff(spark, d))


def _searched(spark, d, problems):
    """Statuses of ``problems`` (name to shares of the summed p99, of insured value, of the summed p99), searched at once."""
    c = _cohorts(spark, d).withColumn("loss_p99", F.col("loss_p50") * 7.2)
    p99, tiv = c.agg(F.sum("loss_p99"), F.sum("total_tiv")).first()
    return Q.search(c, {n: (a * p99, z * p99, b * tiv) for n, (a, b, z) in problems.items()})[0]


@query(None)
def o8_sensitivity(spark, d):
    """Three by three budgets, capital and non-renewal at 0.7, 1 and 1.5 times theirs: nine problems in one search."""
    cells = {f"{a}|{b}": (0.4 * a, 0.2 * b, 0.05) for a in (0.7, 1.0, 1.5) for b in (0.7, 1.0, 1.5)}
    rows = [(*map(float, n.split("|")), f.status, f.objective, f.bound) for n, f in _searched(spark, d, cells).items()]
    return spark.createDataFrame(rows, "capital double, nonrenew double, status string, objective double, bound double")


@query(None)
def o7_relaxed_retry(spark, d):
    """Shares of the summed p99 as capital: problems proven infeasible are tried once more with half as much again."""
    asked = {f"{a}|{b}": (a, b, 0.02) for a, b in ((0.4, 0.2), (-0.1, 0.2), (0.08, 0.0), (0.7, 0.0))}
    found = _searched(spark, d, asked)
    again = {n: (1.5 * a, b, z) for n, (a, b, z) in asked.items() if found[n].status == "Infeasible"}
    relaxed = _searched(spark, d, again) if again else {}
    rows = []
    for n, f in found.items():
        r = relaxed.get(n)
        status = "Infeasible_relaxed" if r and r.objective is not None else f.status
        rows.append((*map(float, n.split("|")), status, 1.5 if r else None, r.objective if r else f.objective))
    return spark.createDataFrame(rows, "capital double, nonrenew double, status string, factor double, objective double")


@query(None)
def r10_replications(spark, d):
    """Objectives of replications with sampled losses, and their envelope beside them."""
    from ..operators.calibrate import envelope

    rows = Q.replications(_cohorts(spark, d), draws=200, times=3, capital_share=0.6, nonrenew_share=0.5, cession_share=0.05)
    return rows.crossJoin(F.broadcast(envelope(rows.where("x IS NOT NULL"))))


@query(oracle(*BOOK, "SELECT state, count(*) AS n, round(sum(w * tiv) / sum(tiv), 9) AS weighted_wind FROM (SELECT state, tiv, round((100 + id % 60) * exp(-exp(ln(30) + 1.2::DOUBLE * " + normal_sql("id") + ") / 80.5::DOUBLE), 6) AS w FROM policies) GROUP BY state"))
def r8_training_winds(spark, d):
    km = F.exp(F.log(F.lit(30)) + 1.2 * S.normal("id"))
    w = F.round((100 + F.col("id") % 60) * F.exp(-km / 80.5), 6)
    return policies(spark, d).withColumn("w", w).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("tiv")) / F.sum("tiv"), 9).alias("weighted_wind"))


@query(oracle(BOOK[0], f"SELECT k AS id, zip3, state, round(exp(12.5::DOUBLE + 0.6::DOUBLE * {normal_sql('k * 3 + 7')}), 2) AS tiv, round(alat + greatest(-0.18::DOUBLE, least(0.18::DOUBLE, 0.06::DOUBLE * {normal_sql('k * 3 + 8')})), 6) AS lat FROM (SELECT k, floor({lcg_sql('k * 3 + 9')} * 38)::INT AS i FROM (SELECT unnest(range(5000)) AS k)) JOIN anchors USING (i)"))
def s21_synthetic_book(spark, d):
    k = F.col("id")
    rows = spark.range(5000).withColumn("i", F.floor(S.lcg(k * 3 + 9) * 38).cast("int")).join(F.broadcast(anchors(spark)), "i")
    jitter = F.greatest(F.lit(-0.18), F.least(F.lit(0.18), 0.06 * S.normal(k * 3 + 8)))
    return rows.select("id", "zip3", "state", F.round(F.exp(12.5 + 0.6 * S.normal(k * 3 + 7)), 2).alias("tiv"), F.round(F.col("alat") + jitter, 6).alias("lat"))


_MAE = ", ".join(f"round(avg(abs(v[{i + 1}]::DOUBLE - {i})) FILTER (WHERE (id + {i}) % 5 <> 0), 6) AS mae{i}" for i in (1, 3, 6))


@query(oracle(*BOOK, f"SELECT {_MAE} FROM (SELECT id, try_cast(cv_features AS DOUBLE[]) AS v FROM policies) WHERE len(v) = 8"))
def a35_label_errors(spark, d):
    """Mean error of image features against weak labels, where there is a label."""
    rows = policies(spark, d).withColumn("v", F.from_json("cv_features", "array<double>")).where("size(v) = 8")
    return rows.agg(*(F.round(F.avg(F.when((F.col("id") + i) % 5 != 0, F.abs(F.col("v")[i] - i))), 6).alias(f"mae{i}") for i in (1, 3, 6)))


@query(None)
def j19_label_overlay(spark, d):
    """Weak labels replace three positions of the feature vector where there are any."""
    labels = policies(spark, d).where("id % 4 = 0").select("id", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("label"))
    rows = policies(spark, d).withColumn("v", F.from_json("cv_features", "array<double>")).where("size(v) = 8").join(labels, "id", "left")
    out = F.transform("v", lambda x, i: F.when(i == 1, F.coalesce(F.col("label")[0], x)).when(i == 3, F.coalesce(F.col("label")[1], x)).when(i == 6, F.coalesce(F.col("label")[2], x)).otherwise(x))
    return rows.select("id", F.array_join(out.cast("array<string>"), ",").alias("features"))
