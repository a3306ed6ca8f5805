"""Queries on treaty terms, checks of entries, logged states, storms and the reconciler."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import checks as K
from ..operators import treaty as T
from ..operators.staging import staged
from ..sources import feeds as S
from . import decide as E
from .domain import BOOK, oracle, policies, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _pick(names, n):
    return F.element_at(F.array(*(F.lit(x) for x in names)), (n % len(names) + 1).cast("int"))


@query(oracle(*BOOK, """t AS (SELECT id, tiv / 10 - 9000 AS loss, (id % 7)::DOUBLE / 4 - 0.25::DOUBLE AS share, premium_annual AS prem, 5000::DOUBLE AS a, (5000 + (id % 5) * 2500)::DOUBLE AS b, id % 4 - 1 AS n FROM policies),
 u AS (SELECT *, greatest(0::DOUBLE, loss) AS l, least(1::DOUBLE, greatest(0::DOUBLE, share)) AS s, b - a AS w, greatest(0, n) AS r FROM t),
 v AS (SELECT *, least(greatest(0::DOUBLE, least(loss, b) - a), w * (1 + r)) AS paid, l * 0.3::DOUBLE + prem AS trapped FROM u)""",
    """SELECT id, round(l * s, 6) AS kept, round(l * (1 - s), 6) AS ceded, round(prem * s, 6) AS fee, round(w * 0.07::DOUBLE, 6) AS coupon, round(trapped, 6) AS trapped, round(greatest(0::DOUBLE, l - trapped), 6) AS free,
 round(CASE WHEN l > 0 THEN least(1::DOUBLE, trapped / l) ELSE 0 END, 9) AS trapped_share, w * (1 + r) AS capacity, round(paid, 6) AS paid, round(greatest(0::DOUBLE, w * (1 + r) - paid), 6) AS remaining, round(CASE WHEN w > 0 THEN paid / w * prem * 0.5::DOUBLE ELSE 0 END, 6) AS reinstatement FROM v"""))  # fmt: skip
def f19_treaty_terms(spark, d):
    k = F.col("id")
    rows = policies(spark, d).select("id", (F.col("tiv") / 10 - 9000).alias("loss"), ((k % 7) / F.lit(4.0) - 0.25).alias("share"), F.col("premium_annual").alias("prem"), (5000 + (k % 5) * 2500).cast("double").alias("b"), (k % 4 - 1).alias("n"))
    a, b, loss = F.lit(5000.0), F.col("b"), F.col("loss")
    kept, ceded = T.fronted(loss, F.col("share"))
    c = T.captive(loss, 0.3 * F.greatest(F.lit(0.0), loss), F.col("prem"), F.lit(-1.0))
    capacity = T.initial_capacity(a, b, F.col("n"))
    paid, left = T.paid_by_layer(loss, a, b, capacity)
    four = {"kept": kept, "ceded": ceded, "fee": T.fronting_fee(F.col("prem"), F.col("share")), "coupon": T.coupon(b - a, F.lit(0.07)), "trapped": c["trapped"], "free": c["free"], "paid": paid, "remaining": left, "reinstatement": T.reinstatement_premium(paid, b - a, F.col("prem"), F.lit(0.5))}
    return rows.select("id", *(F.round(x, 6).alias(n) for n, x in four.items()), F.round(c["trapped_share"], 9).alias("trapped_share"), capacity.alias("capacity"))


_LEVELS = ("ef0", "minor", "high", "limited", "extreme", "none", "ef5")


@query(f"""SELECT n, CASE WHEN size < 4 THEN 'ring' WHEN n % 11 = 0 THEN 'closed' WHEN peril = 'tornado' AND NOT coalesce(width > 0, false) THEN 'width' WHEN peril = 'earthquake' AND n % 13 = 1 THEN 'epicenter'
 WHEN NOT CASE WHEN peril = 'earthquake' THEN coalesce(number BETWEEN 5 AND 9, false) WHEN peril = 'hail' THEN coalesce(number BETWEEN 10 AND 120, false)
   ELSE coalesce(list_contains(CASE peril {" ".join(f"WHEN '{p}' THEN {list(names)}" for p, names in X.LEVELS.items())} END, level), false) END THEN 'severity' END AS fault
 FROM (SELECT p_partkey AS n, 3 + p_partkey % 4 AS size, (ARRAY{list(X.PERILS)})[p_partkey % 6 + 1] AS peril, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3 END AS width,
       CASE WHEN p_partkey % 9 <> 0 THEN (ARRAY{list(_LEVELS)})[p_partkey % 7 + 1] END AS level, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 17)::DOUBLE END AS number FROM part)""")
def p18_footprint_faults(spark, d):
    k = F.col("p_partkey")
    size = 3 + k % 4
    corner = lambda i: F.struct(F.when((i == size - 1) & (k % 11 != 0), 0).otherwise(i).alias("x"), F.lit(1).alias("y"))
    rows = table(spark, d, "part").select(k.alias("n"), F.transform(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1), corner).alias("ring"), _pick(X.PERILS, k).alias("peril"), F.when(k % 4 != 0, k % 3).alias("width"),
        F.when(k % 13 != 1, F.lit(0)).alias("epicenter"), F.when(k % 9 != 0, _pick(_LEVELS, k)).alias("level"), F.when(k % 5 != 0, (k % 17).cast("double")).alias("number"))
    return rows.select("n", K.footprint_fault(F.col("ring"), F.col("peril"), F.col("width"), F.col("epicenter"), F.col("level"), F.col("number")).alias("fault"))


@query(f"""SELECT n, CASE WHEN action IS NULL OR NOT list_contains({list(X.ACTIONS)}, action) THEN 'action' WHEN length(trim(coalesce(operator, ''))) = 0 THEN 'operator' WHEN length(trim(rationale)) < 10 THEN 'rationale' END AS pin,
 CASE WHEN NOT coalesce(balance > 0, false) THEN 'capital_budget' WHEN NOT coalesce(pct BETWEEN 0 AND 1, false) THEN 'max_nonrenew_pct' WHEN n % 6 = 0 THEN 'cession_budget' END AS budget, n % 3 <> 0 AS valid_id
 FROM (SELECT c_custkey AS n, CASE WHEN c_custkey % 10 <> 0 THEN (ARRAY{[*X.ACTIONS, 'cede']})[c_custkey % 12 + 1] END AS action, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE 'ana' END AS operator, substring('because of flood', 1, (c_custkey % 17)::INT) AS rationale,
        c_acctbal AS balance, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 13)::DOUBLE / 10 END AS pct FROM customer)""")
def p20_entry_faults(spark, d):
    k = F.col("c_custkey")
    action, operator = F.when(k % 10 != 0, _pick((*X.ACTIONS, "cede"), k)), F.when(k % 5 == 0, "  ").when(k % 5 == 1, None).otherwise("ana")
    text = F.when(k % 3 == 0, F.upper(F.sha2(k.cast("string"), 256))).otherwise(F.sha2(k.cast("string"), 256))
    cession = F.when(k % 12 == 0, float("inf")).when(k % 6 == 0, float("nan")).otherwise(5.0)
    return table(spark, d, "customer").select(k.alias("n"), K.pin_fault(action, operator, F.lit("because of flood").substr(F.lit(1), (k % 17).cast("int"))).alias("pin"), K.budget_fault(F.col("c_acctbal"), F.when(k % 8 != 0, (k % 13) / F.lit(10.0)), cession).alias("budget"), K.is_decision_id(text).alias("valid_id"))


@query("""WITH named AS (SELECT user_id AS id, trim(by_whom) AS reversed_by, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n
  FROM (SELECT user_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' ana ' ELSE 'bo' END AS by_whom FROM events WHERE event_type = 'error') WHERE trim(by_whom) <> '')
 SELECT d.id, reversed_by, coalesce(n - 1, 0) AS repeats, reversed_by IS NOT NULL AND d.id % 3 = 0 AS manual FROM (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 5 <> 0) d LEFT JOIN (SELECT * FROM named WHERE r = 1) f USING (id)""")
def d5_reversals(spark, d):
    events = table(spark, d, "events")
    decisions = events.where("user_id % 5 <> 0").select(F.col("user_id").alias("id")).distinct().withColumn("notices_sent", F.col("id") % 3 == 0)
    k = F.col("event_id")
    requests = events.where("event_type = 'error'").select(F.col("user_id").alias("id"), F.when(k % 4 == 0, " ").when(k % 4 == 1, " ana ").otherwise("bo").alias("reversed_by"), "ts", k.alias("seq"))
    return K.reversals(decisions, requests).select("id", "reversed_by", "repeats", "manual")


@query("""WITH m AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'retire' WHEN event_id % 3 = 0 THEN 'promote' ELSE 'edit' END AS move FROM events), e AS (SELECT id, min(seq) AS retired FROM m WHERE move = 'retire' GROUP BY id)
 SELECT m.id, CASE WHEN any_value(retired) IS NOT NULL THEN 'retired' WHEN count(*) FILTER (WHERE move = 'promote') > 0 THEN 'promoted' ELSE 'draft' END AS state, count(*) FILTER (WHERE move = 'promote' AND NOT coalesce(seq > retired, false)) AS promotions,
  count(*) FILTER (WHERE move = 'promote' AND coalesce(seq > retired, false)) AS refused FROM m LEFT JOIN e ON m.id = e.id GROUP BY m.id""")
def d7_simulation_states(spark, d):
    k = F.col("event_id")
    return K.simulation_states(table(spark, d, "events").select(F.col("user_id").alias("id"), k.alias("seq"), F.when(k % 97 == 0, "retire").when(k % 3 == 0, "promote").otherwise("edit").alias("move")))


_CLASSES = (*X.STORM_RANK, "XX")
STORMS_SQL = f"""storms AS (SELECT (ARRAY['AL', 'EP', 'CP'])[s_suppkey % 3 + 1] || lpad(s_suppkey::VARCHAR, 6, '0') AS id, (ARRAY['AL', 'EP', 'CP'])[s_suppkey % 3 + 1] AS basin, CASE WHEN s_suppkey % 7 <> 0 THEN (ARRAY{list(_CLASSES)})[s_suppkey % 10 + 1] END AS classification,
  CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey % 12 * 10)::DOUBLE END AS intensity_kt, (10 + s_suppkey % 30)::DOUBLE AS latitude, CASE WHEN s_suppkey % 9 <> 0 THEN -(60 + s_suppkey % 41)::DOUBLE - 0.5::DOUBLE END AS longitude FROM supplier)"""


def _storms(spark, d):
    k = F.col("s_suppkey")
    basin = _pick(("al", "ep", "cp"), k)
    lat, lon = 10 + k % 30, 60 + k % 41
    line = F.struct(
        F.concat(F.lit(" "), basin, F.lpad(k.cast("string"), 6, "0")).alias("id"), F.when(k % 7 != 0, F.lower(_pick(_CLASSES, k))).otherwise(" ").alias("classification"), F.when(k % 4 != 0, (k % 12 * 10).cast("string")).otherwise("n/a").alias("intensity"),
        F.when(k % 2 == 0, lat.cast("string")).alias("latitudeNumeric"), F.concat(lat.cast("string"), F.lit(".0 n")).alias("latitude"), F.when(k % 9 != 0, F.concat(lon.cast("string"), F.lit(".5W"))).alias("longitude"),
    )
    return S.active_storms(table(spark, d, "supplier").select(F.to_json(line).alias("value")))


@query(oracle(STORMS_SQL, "SELECT id, basin, classification, intensity_kt, latitude, longitude FROM storms"))
def s12_active_storms(spark, d):
    return _storms(spark, d).select("id", "basin", "classification", "intensity_kt", "latitude", "longitude")


@query(oracle(STORMS_SQL, f"""SELECT basin, id, intensity_kt FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY coalesce(CASE classification {" ".join(f"WHEN '{c}' THEN {r}" for c, r in X.STORM_RANK.items())} END, -1) DESC, coalesce(intensity_kt, 0) DESC,
  coalesce(sqrt(pow(latitude - 28, 2) + pow(longitude + 82, 2)), 'inf'::DOUBLE), id) AS r FROM storms) WHERE r = 1"""))
def w5_relevant_storm(spark, d):
    return K.relevant_storm(_storms(spark, d), "basin").select("basin", "id", "intensity_kt")


_PATH = [(27.0, -82.5), (27.6, -81.9), (28.4, -81.2)]


def _leg(a, b):
    px, py, qx, qy = (f"(({o} - lon) * 111.195::DOUBLE * cos(radians(lat)))" if i % 2 == 0 else f"(({o} - lat) * 111.195::DOUBLE)" for i, o in enumerate((a[1], a[0], b[1], b[0])))
    t = f"greatest(0::DOUBLE, least(1::DOUBLE, -({px} * ({qx} - {px}) + {py} * ({qy} - {py})) / (pow({qx} - {px}, 2) + pow({qy} - {py}, 2))))"
    return f"sqrt(pow({px} + {t} * ({qx} - {px}), 2) + pow({py} + {t} * ({qy} - {py}), 2))"


@query(oracle(*BOOK, f"SELECT state, count(*) AS n, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv FROM policies WHERE least({', '.join(_leg(a, b) for a, b in zip(_PATH, _PATH[1:]))}) <= 20 GROUP BY state"))
def f15_tornado_capsule(spark, d):
    inside = K.in_capsule(F.col("lat"), F.col("lon"), _PATH, 40.0)
    return policies(spark, d).where(F.col("lat").between(26.7, 28.7) & F.col("lon").between(-83.0, -80.9) & inside).groupBy("state").agg(F.count("*").alias("n"), F.sum(F.col("tiv").cast("decimal(18,4)")).cast("double").alias("tiv"))


_MOCK = ((0.45, 0.1), (0.5, 0.1), (0.6, 0.1), (0.4, 0.1), (0.3, 0.2), (0.5, 0.1), (0.5, 0.05), (0.55, 0.05))  # fixed values: offsets and widths of the eight features


@query(oracle(*BOOK, "SELECT id, " + ", ".join(f"round(least(1::DOUBLE, greatest(0::DOUBLE, {a}::DOUBLE + {w}::DOUBLE * (s{i} - floor(s{i})))), 5) AS f{i}" for i, (a, w) in enumerate(_MOCK)) + " FROM (SELECT id, " + ", ".join(f"sin((lat + {i}) * 12.9898::DOUBLE + (lon + {i}) * 78.233::DOUBLE) * 43758.5453::DOUBLE AS s{i}" for i in range(8)) + " FROM policies)"))
def f31_mock_vector(spark, d):
    s = [F.sin((F.col("lat") + i) * 12.9898 + (F.col("lon") + i) * 78.233) * 43758.5453 for i in range(8)]
    return policies(spark, d).select("id", *(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a + w * (x - F.floor(x)))), 5).alias(f"f{i}") for i, ((a, w), x) in enumerate(zip(_MOCK, s))))


_TODAY = "2027-11-20"


@query(oracle(*E.ACTED, E.DOMINANT_SQL, E.PINS_SQL, E.STAMPS_SQL, E._ZONES,
    "last_pins AS (SELECT cohort_id, arg_max(pinned_action, seq) AS action FROM stamps GROUP BY 1)",
    "pinned AS (SELECT cohort_id, action, share FROM acts WHERE cohort_id NOT IN (SELECT cohort_id FROM last_pins) UNION ALL SELECT cohort_id, action, 1::DOUBLE FROM last_pins)",
    "nr AS (SELECT c.* FROM cohorts c JOIN pinned USING (cohort_id) WHERE action = 'non_renew' AND share > 0.5)",
    "kept AS (SELECT cohort_id, zip3, greatest(0::DOUBLE, least(1::DOUBLE, 1 - coalesce(sum(share) FILTER (WHERE action IN ('cede_qs', 'cede_xs')), 0))) AS r FROM pinned JOIN cohorts USING (cohort_id) GROUP BY 1, 2)",
    f"notices AS (SELECT cohort_id, days, (CASE WHEN month(renewal) = 2 AND day(renewal) = 29 THEN renewal + INTERVAL 1 YEAR + INTERVAL 1 DAY ELSE renewal + INTERVAL 1 YEAR END)::DATE::VARCHAR AS deferred_to FROM (SELECT cohort_id, renewal, datediff('day', DATE '{_TODAY}', renewal) AS days, {E._NOTICE} AS notice FROM (SELECT cohort_id, state, coalesce({E._RENEWAL}, DATE '{_TODAY}' + 365) AS renewal FROM nr)) WHERE days < notice)",
    E.CAPS_SQL.replace("FROM nr)", "FROM nr WHERE cohort_id NOT IN (SELECT cohort_id FROM notices))"),
    "held AS (SELECT cohort_id, bucket, round(total / denom, 9) AS observed FROM capped WHERE denom > 0 AND total - before > cap * denom)",
    """SELECT 'pin' AS part, cohort_id AS id, pinned_action || '|' || original_action AS what, policy_id::DOUBLE AS value FROM stamps
 UNION ALL SELECT 'preflag', cohort_id, 'policy', id::DOUBLE FROM binned WHERE flood_zone = 'VE' AND cohort_id NOT IN (SELECT cohort_id FROM nr)
 UNION ALL SELECT 'demand', zone_id::VARCHAR, 'zone', round(avg(r), 6) FROM zones JOIN kept USING (zip3) WHERE zone_id IN (SELECT zone_id FROM assigned) GROUP BY zone_id
 UNION ALL SELECT 'conflict', cohort_id, zone_id::VARCHAR, staff::DOUBLE FROM nr JOIN zones USING (zip3) JOIN assigned USING (zone_id) WHERE staff >= 2
 UNION ALL SELECT 'non_renew_next_renewal', cohort_id, deferred_to, days::DOUBLE FROM notices
 UNION ALL SELECT 'non_renew_capped', cohort_id, bucket, observed FROM held
 UNION ALL SELECT 'notification', cohort_id, CASE WHEN cohort_id IN (SELECT cohort_id FROM held) THEN 'non_renew_capped' WHEN cohort_id IN (SELECT cohort_id FROM notices) THEN 'non_renew_next_renewal' ELSE 'non_renew' END, policy_count::DOUBLE FROM nr
 UNION ALL SELECT 'stamps', cohort_id, 'count', (SELECT count(*) FROM stamps s WHERE s.cohort_id = nr.cohort_id) + (cohort_id IN (SELECT cohort_id FROM notices))::INT + (cohort_id IN (SELECT cohort_id FROM held))::INT FROM nr"""))  # fmt: skip
def o9_reconciled(spark, d):
    """All that the reconciler's passes leave, in one long table."""
    from ..functions.scalars import money_sum, territory
    from ..operators import cohort as C
    from ..operators.loss import cohort_number

    book = C.binned(policies(spark, d))
    cohorts, n = staged(C.cohorts(book), "cohorts"), cohort_number()
    zones, staff = E._zones(spark, d)
    totals = cohorts.groupBy(territory("zip3", "state").alias("bucket")).agg(money_sum("total_tiv").alias("bucket_tiv")).where("bucket <> 'NC:inland'")
    renewals = cohorts.select("cohort_id", F.when(n % 4 != 0, F.date_add(F.lit("2027-12-01").cast("date"), (n % 200).cast("int"))).alias("renewal"))
    out = K.reconcile(E._actions(cohorts), cohorts.select("cohort_id", "zip3", "state", "total_tiv", "policy_count"), pins=E._pins(spark, d), policy_cohorts=book, preflags=book.where("flood_zone = 'VE'").select("id", "cohort_id"), zones=zones, staff=staff, renewals=renewals, bucket_totals=totals, today=F.lit(_TODAY).cast("date"))
    part = lambda df, name, id_, what, value: df.select(F.lit(name).alias("part") if isinstance(name, str) else name.alias("part"), F.col(id_).cast("string").alias("id"), what.alias("what"), value.cast("double").alias("value"))
    col = F.col
    what = F.when(col("kind") == "pin", F.concat_ws("|", "detail", "original_action")).otherwise(col("detail"))
    parts = [
        part(out.stamps, col("kind"), "cohort_id", what, col("value")), part(out.preflags, "preflag", "cohort_id", F.lit("policy"), col("id")), part(out.demand, "demand", "zone_id", F.lit("zone"), F.round("demand", 6)),
        part(out.conflicts, "conflict", "cohort_id", col("zone_id").cast("string"), col("staff")), part(out.notifications, "notification", "cohort_id", col("action"), col("policy_count")), part(out.notifications, "stamps", "cohort_id", F.lit("count"), col("stamps")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query(oracle(*BOOK, """m AS (SELECT id, state, tiv FROM policies WHERE id % 9 <> 0)""",
    """SELECT id AS policy_id, state, tiv, '{"src_file":"book.csv","src_row":' || (id + 2) || ',"mapped_at":"2026-01-01","refused_columns":["a_note","owner"]}' AS lineage FROM m"""))
def p6_mapped_with_lineage(spark, d):
    from ..operators.ingest import mapped

    rows = policies(spark, d).where("id % 9 <> 0").select(F.col("id").alias("Policy"), F.col("state").alias("St"), F.col("tiv").alias("Insured Value"), F.lit("x").alias("owner"), F.lit("y").alias("a_note"), F.col("id").alias("row"))
    return mapped(rows, {"policy_id": "Policy", "state": "St", "tiv": "Insured Value"}, refused=["owner", "a_note"], file="book.csv", at="2026-01-01", index="row")
