"""Queries on decisions: action mixes, pins, reconciliation, caps, optimizer, ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import money_sum
from ..operators import cohort as C
from ..operators import decide as D
from ..operators import ledger as G
from ..operators.loss import cohort_number
from .domain import COHORTED, COHORTS, oracle, policies, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


_N = "((zip3::BIGINT * 10 + CASE build_type WHEN 'wood_frame' THEN 0 WHEN 'masonry' THEN 1 ELSE 2 END) * 10 + tiv_quintile)"
_ACTS = "[" + ", ".join(f"'{a}'" for a in X.ACTIONS) + "]"
_IDX = "CASE action " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(X.ACTIONS)) + " END"
ACTIONS_SQL = f"""acts AS (SELECT cohort_id, zip3, total_tiv, total_premium, loss_p50, state, {_ACTS}[{_N} % 11 + 1] AS action, CASE WHEN {_N} % 2 = 1 THEN 0.7::DOUBLE ELSE 1::DOUBLE END AS share FROM cohorts
  UNION ALL SELECT cohort_id, zip3, total_tiv, total_premium, loss_p50, state, {_ACTS}[({_N} + 3) % 11 + 1], 0.3::DOUBLE FROM cohorts WHERE {_N} % 2 = 1)"""
DOMINANT_SQL = f"dom AS (SELECT cohort_id, total_tiv, action, share FROM (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY share DESC, {_IDX}) AS r FROM acts) WHERE r = 1)"
ACTED = (*COHORTS, ACTIONS_SQL)
_DIM = ", ".join(f"('{a}')" for a in X.ACTIONS)


def _cohorts(spark, d):
    return C.cohorts(C.binned(policies(spark, d)))


def _actions(cohorts):
    n = cohort_number()
    act = lambda i: F.element_at(F.array(*map(F.lit, X.ACTIONS)), (i % 11 + 1).cast("int"))
    one = F.struct(act(n).alias("action"), F.when(n % 2 == 1, 0.7).otherwise(1.0).alias("share"))
    two = F.struct(act(n + 3).alias("action"), F.lit(0.3).alias("share"))
    return cohorts.select("cohort_id", F.explode(F.when(n % 2 == 1, F.array(one, two)).otherwise(F.array(one))).alias("a")).select("cohort_id", "a.action", "a.share")


@query(oracle(*ACTED, DOMINANT_SQL, "SELECT cohort_id, action, share FROM dom"))
def a18_dominant_actions(spark, d):
    return D.dominant(_actions(_cohorts(spark, d)))


@query(oracle(*ACTED, DOMINANT_SQL, f"SELECT a.action, count(dom.cohort_id) AS n, coalesce(sum(total_tiv::DECIMAL(18,4)), 0)::DOUBLE AS tiv FROM (VALUES {_DIM}) a(action) LEFT JOIN dom USING (action) GROUP BY 1"))
def a17_action_summary(spark, d):
    c = _cohorts(spark, d)
    return D.action_summary(_actions(c), c)


@query(oracle(*ACTED, f"SELECT zip3, action, w FROM (SELECT zip3, action, w, row_number() OVER (PARTITION BY zip3 ORDER BY w DESC, {_IDX}) AS r FROM (SELECT zip3, action, sum((total_tiv * share)::DECIMAL(18,4))::DOUBLE AS w FROM acts GROUP BY zip3, action)) WHERE r = 1"))
def a19_zip3_actions(spark, d):
    c = _cohorts(spark, d)
    rows = _actions(c).join(c, "cohort_id").groupBy("zip3", "action").agg(money_sum(F.col("total_tiv") * F.col("share")).alias("w"))
    return D.dominant(rows.select(F.col("zip3").alias("cohort_id"), "action", F.col("w").alias("share"))).select(F.col("cohort_id").alias("zip3"), "action", F.col("share").alias("w"))


@query(oracle(*ACTED, "SELECT round(sum((loss_p50 * CASE action WHEN 'cede_qs' THEN 0.6::DOUBLE WHEN 'cede_xs' THEN 0.15::DOUBLE ELSE 0 END * share)::DECIMAL(18,6))::DOUBLE, 3) AS spend FROM acts"))
def a20_cession_spend(spark, d):
    c = _cohorts(spark, d)
    rows = _actions(c).join(F.broadcast(D.action_dim(spark)), "action").join(c.select("cohort_id", "loss_p50"), "cohort_id")
    return rows.agg(F.round(money_sum(F.col("loss_p50") * F.col("ceded_share") * F.col("share"), 6), 3).alias("spend"))


PINS_SQL = f"pins AS (SELECT c_custkey * 9 AS policy_id, {_ACTS}[c_custkey % 11 + 1] AS pinned_action, c_custkey AS seq FROM customer)"


def _pins(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select((k * 9).alias("policy_id"), F.element_at(F.array(*map(F.lit, X.ACTIONS)), (k % 11 + 1).cast("int")).alias("pinned_action"), k.alias("seq"))


STAMPS_SQL = "stamps AS (SELECT d.cohort_id, policy_id, pinned_action, seq, coalesce(lag(pinned_action) OVER (PARTITION BY d.cohort_id ORDER BY seq), d.action) AS original_action FROM pins JOIN binned b ON b.id = policy_id JOIN dom d ON d.cohort_id = b.cohort_id)"


@query(oracle(*ACTED, DOMINANT_SQL, PINS_SQL, STAMPS_SQL, "SELECT * FROM stamps"))
def j3_pin_stamps(spark, d):
    book = C.binned(policies(spark, d))
    return D.apply_pins(_actions(C.cohorts(book)), _pins(spark, d), book)[0]


@query(oracle(*ACTED, DOMINANT_SQL, PINS_SQL, STAMPS_SQL, "SELECT action, count(*) AS n, round(sum(share), 6) AS shares FROM (SELECT cohort_id, action, share FROM acts WHERE cohort_id NOT IN (SELECT cohort_id FROM stamps) UNION ALL SELECT cohort_id, arg_max(pinned_action, seq), 1 FROM stamps GROUP BY 1) GROUP BY 1"))
def j3_pinned_actions(spark, d):
    book = C.binned(policies(spark, d))
    return D.apply_pins(_actions(C.cohorts(book)), _pins(spark, d), book)[1].groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("share"), 6).alias("shares"))


NR_SQL = "nr AS (SELECT cohort_id, zip3, state, total_tiv, share FROM acts WHERE action = 'non_renew' AND share > 0.5)"


@query(oracle(*ACTED, NR_SQL, "SELECT id, cohort_id FROM binned WHERE flood_zone = 'VE' AND cohort_id NOT IN (SELECT cohort_id FROM nr)"))
def j4_preflag_kept(spark, d):
    book = C.binned(policies(spark, d))
    gone = D.non_renewed(_actions(C.cohorts(book)))
    return book.where("flood_zone = 'VE'").join(gone, "cohort_id", "left_anti").select("id", "cohort_id")


_ZONES = "zones AS (SELECT n_nationkey AS zone_id, zip3 FROM nation JOIN anchors ON i = n_nationkey), assigned AS (SELECT (s_suppkey % 20)::INT AS zone_id, count(*) AS staff FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1)"


def _zones(spark, d):
    from .domain import anchors

    zones = table(spark, d, "nation").join(anchors(spark), F.col("n_nationkey") == F.col("i")).select(F.col("n_nationkey").alias("zone_id"), "zip3")
    staff = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").groupBy((F.col("s_suppkey") % 20).cast("int").alias("zone_id")).agg(F.count("*").alias("staff"))
    return zones, staff


@query(oracle(*ACTED, _ZONES, "kept AS (SELECT cohort_id, zip3, greatest(0::DOUBLE, least(1::DOUBLE, 1 - sum(share) FILTER (WHERE action IN ('cede_qs', 'cede_xs')))) AS r FROM acts GROUP BY 1, 2)", "SELECT zone_id, round(avg(coalesce(r, 1)), 6) AS demand FROM zones JOIN kept USING (zip3) WHERE zone_id IN (SELECT zone_id FROM assigned) GROUP BY 1"))
def j5_zone_demand(spark, d):
    c = _cohorts(spark, d)
    ceded = F.coalesce(F.sum(F.when(F.col("action").isin("cede_qs", "cede_xs"), F.col("share"))), F.lit(0.0))
    kept = _actions(c).groupBy("cohort_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ceded)).alias("r")).join(c.select("cohort_id", "zip3"), "cohort_id")
    zones, staff = _zones(spark, d)
    return zones.join(staff, "zone_id", "left_semi").join(kept, "zip3").groupBy("zone_id").agg(F.round(F.avg("r"), 6).alias("demand"))


@query(oracle(*ACTED, NR_SQL, _ZONES, "SELECT cohort_id, zone_id, staff FROM nr JOIN zones USING (zip3) JOIN assigned USING (zone_id) WHERE staff >= 2"))
def j6_staffing_conflicts(spark, d):
    c = _cohorts(spark, d)
    zones, staff = _zones(spark, d)
    nr = D.non_renewed(_actions(c)).join(c.select("cohort_id", "zip3"), "cohort_id")
    return nr.join(zones, "zip3").join(staff, "zone_id").where(F.col("staff") >= X.STAFFED).select("cohort_id", "zone_id", "staff")


_TERRITORY = "CASE state " + " ".join(f"WHEN '{s}' THEN CASE WHEN zip3 IN ({', '.join(repr(z) for z in zs)}) THEN '{X.BUCKET_NAMES[s][0]}' ELSE '{X.BUCKET_NAMES[s][1]}' END" for s, zs in X.COASTAL.items()) + " ELSE '__default__' END"
_CAP = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {v!r}::DOUBLE" for b, v in X.CAPS.items()) + " END"
CAPS_SQL = f"""buckets AS (SELECT {_TERRITORY} AS bucket, sum(total_tiv::DECIMAL(18,4))::DOUBLE AS bucket_tiv FROM cohorts GROUP BY 1 HAVING {_TERRITORY} <> 'NC:inland'),
capped AS (SELECT cohort_id, bucket, {_CAP} AS cap, total, before, coalesce(bucket_tiv, total) AS denom FROM (
  SELECT *, (sum(total_tiv::DECIMAL(18,4)) OVER (PARTITION BY bucket))::DOUBLE AS total, coalesce((sum(total_tiv::DECIMAL(18,4)) OVER (PARTITION BY bucket ORDER BY total_tiv, cohort_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0) AS before
  FROM (SELECT cohort_id, total_tiv, {_TERRITORY} AS bucket FROM nr)) LEFT JOIN buckets USING (bucket))"""


@query(oracle(*ACTED, NR_SQL, CAPS_SQL, "SELECT cohort_id, bucket, cap, round(total / denom, 9) AS observed FROM capped WHERE denom > 0 AND total - before > cap * denom"))
def w1_territory_caps(spark, d):
    from ..functions.scalars import territory

    c = _cohorts(spark, d)
    totals = c.groupBy(territory("zip3", "state").alias("bucket")).agg(money_sum("total_tiv").alias("bucket_tiv")).where("bucket <> 'NC:inland'")
    nr = D.non_renewed(_actions(c)).join(c.select("cohort_id", "zip3", "state", "total_tiv"), "cohort_id")
    return D.territory_caps(nr, totals)


_RENEWAL = f"CASE WHEN {_N} % 4 <> 0 THEN DATE '2027-12-01' + ({_N} % 200)::INT END"
_NOTICE = "CASE state " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in X.NOTICE_DAYS.items()) + f" ELSE {X.NOTICE_DEFAULT} END"


@query(oracle(*ACTED, NR_SQL, f"""SELECT cohort_id, days::INT AS days, notice::INT AS notice, (CASE WHEN month(renewal) = 2 AND day(renewal) = 29 THEN renewal + INTERVAL 1 YEAR + INTERVAL 1 DAY ELSE renewal + INTERVAL 1 YEAR END)::DATE::VARCHAR AS deferred_to
 FROM (SELECT cohort_id, renewal, datediff('day', DATE '2027-11-20', renewal) AS days, {_NOTICE} AS notice FROM (SELECT cohort_id, state, coalesce({_RENEWAL}, DATE '2027-11-20' + 365) AS renewal FROM cohorts WHERE cohort_id IN (SELECT cohort_id FROM nr))) WHERE days < notice"""))
def f27_notice_deferrals(spark, d):
    c = _cohorts(spark, d)
    n = cohort_number()
    rows = c.join(D.non_renewed(_actions(c)), "cohort_id", "left_semi").withColumn("renewal", F.when(n % 4 != 0, F.date_add(F.lit("2027-12-01").cast("date"), (n % 200).cast("int"))))
    return D.notice_deferrals(rows, F.lit("2027-11-20").cast("date")).withColumn("deferred_to", F.col("deferred_to").cast("string"))


# the optimizer's step at given prices
_PREM = "CASE action " + " ".join(f"WHEN '{a}' THEN {(0.0 if a == 'non_renew' else 0.5 if a == 'cede_qs' else 1.0 if a not in X.RATE_CHANGE else (1 + X.RATE_CHANGE[a]) * (1 - X.ELASTICITY * max(X.RATE_CHANGE[a], 0.0)))!r}::DOUBLE" for a in X.ACTIONS) + " END"
_LOSS = "CASE action WHEN 'non_renew' THEN 0::DOUBLE WHEN 'cede_qs' THEN 0.5::DOUBLE ELSE 1::DOUBLE END"
_COST = "CASE action WHEN 'cede_qs' THEN 0.65::DOUBLE WHEN 'cede_xs' THEN 0.12::DOUBLE ELSE 0::DOUBLE END"
_CEDED = "CASE action WHEN 'cede_qs' THEN 0.6::DOUBLE WHEN 'cede_xs' THEN 0.15::DOUBLE ELSE 0::DOUBLE END"
COEF_SQL = f"""coef AS (SELECT cohort_id, action, {_IDX} AS idx, total_premium * {_PREM} - loss_p50 * {_LOSS} - loss_p50 * {_COST} AS profit,
  CASE WHEN action = 'cede_xs' THEN least(loss_p99, 1.5::DOUBLE * loss_p50) + greatest(0::DOUBLE, loss_p99 - 2::DOUBLE * loss_p99) ELSE loss_p99 * {_LOSS} END AS capital, total_premium * {_CEDED} AS cession, CASE WHEN action = 'non_renew' THEN total_tiv ELSE 0 END AS nonrenew
  FROM (SELECT *, loss_p50 * 7.2::DOUBLE AS loss_p99 FROM cohorts), (VALUES {_DIM}) a(action))"""


def _priced(spark, d):
    return _cohorts(spark, d).withColumn("loss_p99", F.col("loss_p50") * 7.2)


@query(oracle(*COHORTS, COEF_SQL, "SELECT cohort_id, action FROM (SELECT cohort_id, action, row_number() OVER (PARTITION BY cohort_id ORDER BY round(profit - 0.05::DOUBLE * capital - 0.4::DOUBLE * cession - 0.001::DOUBLE * nonrenew, 6) DESC, idx) AS r FROM coef) WHERE r = 1"))
def o3_priced_actions(spark, d):
    return D.best_actions(D.coefficients(_priced(spark, d)), 0.05, 0.4, 0.001).select("cohort_id", "action")


@query(oracle(*COHORTS, COEF_SQL, "SELECT cohort_id, action, round(profit, 4) AS profit, round(capital, 4) AS capital, round(cession, 4) AS cession, nonrenew FROM coef"))
def o5_coefficients(spark, d):
    return D.coefficients(_priced(spark, d)).select("cohort_id", "action", F.round("profit", 4).alias("profit"), F.round("capital", 4).alias("capital"), F.round("cession", 4).alias("cession"), "nonrenew")


@query(None)
def o1_portfolio(spark, d):
    """The portfolio under three budgets: no SQL, as it is found by search; objective and the dual bound stand beside each action."""
    from ..operators import portfolio as P

    c = _priced(spark, d)
    p99 = c.agg(F.sum("loss_p99")).first()[0]
    found, actions = P.search_one(c, capital=0.4 * p99, nonrenew_share=0.2, cession=0.05 * p99)
    return actions.select("cohort_id", "action", F.lit(found.status).alias("status"), F.lit(found.objective).alias("objective"), F.lit(found.bound).alias("bound"))


# -------------------------------------------------------------- ledger

LEDGER_SQL = "ledger AS (SELECT sha256(event_type || '|' || (user_id % 50)::VARCHAR) AS id, ts, event_id, event_type, user_id FROM events)"


def _ledger(spark, d):
    return table(spark, d, "events").select(F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 50).cast("string")), 256).alias("id"), "ts", "event_id", "event_type", "user_id")


@query(oracle(LEDGER_SQL, "SELECT id, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS r FROM ledger) WHERE r = 1"))
def d2_idempotent_append(spark, d):
    return G.first_writes(_ledger(spark, d), "id", "ts", "event_id").select("id", F.col("event_id").alias("first_event"))


@query(oracle(LEDGER_SQL, "SELECT id, min(event_id) AS event_id FROM ledger WHERE id NOT IN (SELECT id FROM ledger WHERE event_type = 'view') GROUP BY id"))
def d3_insert_or_ignore(spark, d):
    rows = _ledger(spark, d)
    return G.insert_or_ignore(rows.where("event_type = 'view'"), rows, "id", "event_id").select("id", "event_id")


QUEUE_SQL = "moves AS (SELECT user_id AS decision_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'cancel' END AS move FROM events)"


@query(oracle(QUEUE_SQL, """folded AS (WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY seq) AS n FROM moves),
  walk AS (SELECT decision_id, n, seq, CASE WHEN move = 'enqueue' THEN 'pending' ELSE 'none' END AS state FROM numbered WHERE n = 1
  UNION ALL SELECT w.decision_id, m.n, m.seq, CASE WHEN w.state = 'none' AND m.move = 'enqueue' THEN 'pending' WHEN w.state = 'pending' AND m.move = 'claim' THEN 'claimed' WHEN w.state = 'pending' AND m.move = 'cancel' THEN 'cancelled'
   WHEN w.state = 'claimed' AND m.move = 'complete' THEN 'completed' WHEN w.state = 'claimed' AND m.move = 'fail' THEN 'failed' ELSE w.state END FROM walk w JOIN numbered m ON m.decision_id = w.decision_id AND m.n = w.n + 1) SELECT decision_id, arg_max(state, n) AS state FROM walk GROUP BY 1)""", "SELECT * FROM folded"))
def d6_queue_states(spark, d):
    e = F.col("event_type")
    move = F.when(e == "signup", "enqueue").when(e == "click", "claim").when(e == "purchase", "complete").when(e == "error", "fail").otherwise("cancel")
    return G.fold_queue(table(spark, d, "events").select(F.col("user_id").alias("decision_id"), F.col("event_id").alias("seq"), move.alias("move")))


@query(oracle(LEDGER_SQL, "SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM ledger"))
def j15_previous_decision(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _ledger(spark, d).select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("previous"), F.row_number().over(w).cast("long").alias("n"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'signup') WHERE r = 1")
def w13_next_in_queue(spark, d):
    rows = table(spark, d, "events").where("event_type = 'signup'")
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT kind, id, ts FROM (SELECT 'decision' AS kind, event_id AS id, ts FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'chat', o_orderkey, o_orderdate FROM orders) ORDER BY ts DESC, kind, id LIMIT 25")
def w6_timeline(spark, d):
    a = table(spark, d, "events").where("event_type = 'purchase'").select(F.lit("decision").alias("kind"), F.col("event_id").alias("id"), "ts")
    b = table(spark, d, "orders").select(F.lit("chat").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"))
    return a.unionByName(b).orderBy(F.desc("ts"), "kind", "id").limit(25)


@query("SELECT user_id, kind, n, prior, n - prior AS change FROM (SELECT user_id, kind, coalesce(a, 0) AS n, coalesce(b, 0) AS prior FROM (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.kind, y.kind) AS kind, a, b FROM (SELECT user_id, event_type AS kind, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) x FULL JOIN (SELECT user_id, event_type AS kind, count(*) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) y ON x.user_id = y.user_id AND x.kind = y.kind))")
def w7_decision_diff(spark, d):
    """What changed between two versions, over the union of their keys, in one aggregation."""
    even = F.col("event_id") % 2 == 0
    rows = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count_if(even).alias("n"), F.count_if(~even).alias("prior"))
    return rows.withColumn("change", F.col("n") - F.col("prior"))


@query("SELECT o_orderkey AS sim_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j17_unresolved_sims(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("sim_id"))


@query(oracle("SELECT o_orderkey AS n, sha256('{\"a\":' || o_custkey || ',\"b\":{\"x\":\"' || o_orderstatus || '\",\"y\":' || o_orderkey || '}}') AS digest FROM orders"))
def f25_canonical_digest(spark, d):
    """Keys in order at every level, no white space; ids hash within this engine only."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), G.canonical_digest({"b": {"y": "o_orderkey", "x": "o_orderstatus"}, "a": "o_custkey"}).alias("digest"))


@query(oracle(*COHORTED, "SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(*) AS n, year(o_orderdate - INTERVAL 3 MONTH) || '-Q' || quarter(o_orderdate - INTERVAL 3 MONTH) AS before FROM orders GROUP BY 1, 3"))
def f24_quarters(spark, d):
    name = lambda c: F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return table(spark, d, "orders").groupBy(name("o_orderdate").alias("quarter"), name(F.add_months("o_orderdate", -3)).alias("before")).agg(F.count("*").alias("n"))
