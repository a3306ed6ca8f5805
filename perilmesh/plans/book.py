"""Queries on the policy book: relational core, cohorts, claims pre-brief, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import alert_category, case_of, damage_dollars, half_up, money_sum, severity_tier
from ..operators import cohort as C
from ..operators.claims import adjuster_load, claims_list
from ..operators.ingest import classify_columns, suggest_mapping, validate
from .domain import BOOK, COHORTED, COHORTS, EVENTS_SQL, oracle, policies, storm_events, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


@query(oracle(*BOOK, "SELECT id, state, zip3, county, lat, lon, tiv, build_year, build_type, flood_zone, elevation_m, premium_annual, cv_features FROM policies"))
def s1_table_scan(spark, d):
    return policies(spark, d)


@query(oracle(*BOOK, "SELECT count(*) AS policies, coalesce(sum(tiv::DECIMAL(18,4)), 0)::DOUBLE AS tiv FROM policies"))
def a1_book_totals(spark, d):
    return policies(spark, d).agg(F.count("*").alias("policies"), F.coalesce(money_sum("tiv"), F.lit(0.0)).alias("tiv"))


@query(oracle(*BOOK, "SELECT DISTINCT upper(trim(state)) AS state FROM policies WHERE state <> '' ORDER BY 1"))
def a2_distinct_states(spark, d):
    return policies(spark, d).where("state <> ''").select(F.upper(F.trim("state")).alias("state")).distinct().orderBy("state")


@query(oracle(*BOOK, "SELECT state, count(*) AS policy_count, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv, sum(premium_annual::DECIMAL(18,9))::DOUBLE AS premium FROM policies GROUP BY state"))
def a3_state_aggregates(spark, d):
    return policies(spark, d).groupBy("state").agg(F.count("*").alias("policy_count"), money_sum("tiv").alias("tiv"), money_sum("premium_annual", 9).alias("premium"))


@query(oracle(*BOOK, "SELECT zip3, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM policies WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY zip3"))
def a4_zip3_centroids(spark, d):
    return policies(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("zip3").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


@query(oracle(*BOOK, "SELECT zip3, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(elevation_m), 2) AS elevation_m, count(*) AS n FROM policies WHERE state IN ('FL', 'TX', 'LA', 'NC', 'SC', 'GA', 'AL', 'MS') GROUP BY zip3 HAVING count(*) >= 50 AND avg(elevation_m) IS NOT NULL"))
def a5_coastal_catalog(spark, d):
    rows = policies(spark, d).where(F.col("state").isin("FL", "TX", "LA", "NC", "SC", "GA", "AL", "MS")).groupBy("zip3")
    out = rows.agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("elevation_m"), 2).alias("elevation_m"), F.count("*").alias("n"))
    return out.where("n >= 50 AND elevation_m IS NOT NULL")


@query(oracle(*BOOK, "SELECT zip3, count(*) AS policies, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv FROM policies GROUP BY ROLLUP (zip3)"))
def a6_exposure_rollup(spark, d):
    return policies(spark, d).rollup("zip3").agg(F.count("*").alias("policies"), money_sum("tiv").alias("tiv"))


@query("SELECT round(quantile_cont(o_totalprice, 0.2), 6) AS c1, round(quantile_cont(o_totalprice, 0.4), 6) AS c2, round(quantile_cont(o_totalprice, 0.6), 6) AS c3, round(quantile_cont(o_totalprice, 0.8), 6) AS c4 FROM orders")
def a7_quintile_cuts(spark, d):
    cuts = C.exact_quantiles(policies(spark, d), "tiv", (0.2, 0.4, 0.6, 0.8))
    return spark.createDataFrame([tuple(round(c, 6) for c in cuts)], "c1 double, c2 double, c3 double, c4 double")


@query(oracle(*COHORTED, "SELECT id, q, cohort_id FROM binned"))
def a8_quintile_bins(spark, d):
    return C.binned(policies(spark, d)).select("id", "q", "cohort_id")


@query(oracle(*COHORTS, "SELECT cohort_id, zip3, build_type, tiv_quintile, policy_count, total_tiv, total_premium, round(avg_elevation, 6) AS avg_elevation, modal_zone, round(loss_p50, 4) AS loss_p50 FROM cohorts"))
def a9_cohorts(spark, d):
    out = C.cohorts(C.binned(policies(spark, d)))
    return out.select("cohort_id", "zip3", "build_type", "tiv_quintile", "policy_count", "total_tiv", "total_premium", F.round("avg_elevation", 6).alias("avg_elevation"), "modal_zone", F.round("loss_p50", 4).alias("loss_p50"))


@query(oracle(*COHORTED, "SELECT cohort_id, count(*) AS valid_rows, " + ", ".join(f"round(avg(coalesce(v[{i + 1}], 0)), 6) AS f{i}" for i in range(8)) + " FROM (SELECT cohort_id, try_cast(cv_features AS DOUBLE[]) AS v FROM binned) WHERE len(v) = 8 GROUP BY cohort_id"))
def a9_mean_features(spark, d):
    out = C.mean_features(C.binned(policies(spark, d)))
    return out.select("cohort_id", "valid_rows", *(F.round(f"f{i}", 6).alias(f"f{i}") for i in range(8)))


@query(oracle(*BOOK, "SELECT zip3, flood_zone AS modal_zone FROM (SELECT zip3, flood_zone, row_number() OVER (PARTITION BY zip3 ORDER BY count(*) DESC, flood_zone) AS r FROM policies GROUP BY zip3, flood_zone) WHERE r = 1"))
def a10_modal_zone(spark, d):
    return policies(spark, d).groupBy("zip3").agg(F.mode("flood_zone", True).alias("modal_zone"))


CLAIMS_SQL = """listed AS (SELECT * FROM binned WHERE flood_zone IN ('AE', 'VE') ORDER BY tiv DESC, id LIMIT 500),
claims AS (SELECT l.id, l.zip3, l.cohort_id, l.tiv, CASE WHEN l.build_type = 'manufactured' OR l.flood_zone = 'VE' THEN 'high' WHEN l.flood_zone = 'AE' THEN 'medium' ELSE 'low' END AS severity,
                  round(c.loss_p50 * l.tiv / c.total_tiv, 4) AS expected_loss
           FROM listed l LEFT JOIN (SELECT * FROM cohorts WHERE tiv_quintile <> 1) c USING (cohort_id) ORDER BY expected_loss DESC NULLS LAST, l.id LIMIT 200)"""


def _claims(spark, d):
    book = C.binned(policies(spark, d))
    artifact = C.cohorts(book).where("tiv_quintile <> 1")  # some cohorts have no artifact
    return claims_list(book, artifact)


@query(oracle(*COHORTS, CLAIMS_SQL, "SELECT * FROM claims"))
def e1_claims_prebrief(spark, d):
    """Flagship: severest claims among the largest policies in flood zones."""
    return _claims(spark, d)


@query(oracle(*COHORTS, CLAIMS_SQL, f"""SELECT zip3, count(*) AS policy_count, sum(expected_loss::DECIMAL(18,4))::DOUBLE AS total_expected_loss,
  ceil(sum(expected_loss::DECIMAL(18,4))::DOUBLE / {X.ADJUSTER_DOLLARS})::BIGINT AS needed, ceil(sum(expected_loss::DECIMAL(18,4))::DOUBLE / {X.ADJUSTER_DOLLARS})::BIGINT - {X.ADJUSTER_BASELINE} AS delta
  FROM claims WHERE expected_loss IS NOT NULL GROUP BY zip3"""))
def a22_adjuster_load(spark, d):
    return adjuster_load(_claims(spark, d))


@query(oracle(*COHORTS, """SELECT p.id, p.cohort_id, c.loss_p50 * p.tiv / c.total_tiv AS expected_loss FROM binned p LEFT JOIN (SELECT * FROM cohorts WHERE tiv_quintile <> 1) c USING (cohort_id)"""))
def j1_expected_loss(spark, d):
    book = C.binned(policies(spark, d))
    artifact = C.cohorts(book).where("tiv_quintile <> 1").select("cohort_id", "total_tiv", "loss_p50")
    return book.join(artifact, "cohort_id", "left").select("id", "cohort_id", (F.col("loss_p50") * F.col("tiv") / F.col("total_tiv")).alias("expected_loss"))


@query(oracle(*BOOK, "SELECT CASE WHEN build_type = 'manufactured' OR flood_zone = 'VE' THEN 'high' WHEN flood_zone = 'AE' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM policies GROUP BY 1"))
def p14_severity_tiers(spark, d):
    return policies(spark, d).groupBy(severity_tier().alias("severity")).agg(F.count("*").alias("n"))


@query(oracle(*BOOK, "SELECT id, zip3, flood_zone FROM policies WHERE zip3 IN ('337', '335', '342') AND flood_zone IN ('AE', 'VE')"))
def p9_in_lists(spark, d):
    return policies(spark, d).where(F.col("zip3").isin("337", "335", "342") & F.col("flood_zone").isin("AE", "VE")).select("id", "zip3", "flood_zone")


@query(oracle(EVENTS_SQL, "SELECT event_id, year, state, event_type FROM storm_events WHERE state = 'FL' AND year >= 2021 ORDER BY year DESC, event_id LIMIT 500"))
def p10_recent_events(spark, d):
    return storm_events(spark, d).where("state = 'FL' AND year >= 2021").orderBy(F.desc("year"), "event_id").limit(500).select("event_id", "year", "state", "event_type")


@query(oracle(*BOOK, "SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(build_type, 'wood_frame') AS build_type FROM policies WHERE lat IS NOT NULL AND lon IS NOT NULL ORDER BY id LIMIT 20000"))
def p11_map_points(spark, d):
    rows = policies(spark, d).where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("id").limit(20_000)
    return rows.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.coalesce("build_type", F.lit("wood_frame")).alias("build_type"))


@query(oracle(*BOOK, "SELECT count(*) AS n, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv FROM policies WHERE lat BETWEEN 24 AND 31 AND lon BETWEEN -87.5 AND -79.5"))
def p12_region_box(spark, d):
    return policies(spark, d).where("lat BETWEEN 24 AND 31 AND lon BETWEEN -87.5 AND -79.5").agg(F.count("*").alias("n"), money_sum("tiv").alias("tiv"))


_ALERT = """CASE WHEN e LIKE '%tornado%' THEN 'tornado' WHEN e LIKE '%storm surge%' THEN 'storm_surge' WHEN e LIKE '%severe thunderstorm%' THEN 'severe_thunderstorm' WHEN e LIKE '%hurricane%' THEN 'hurricane'
 WHEN e LIKE '%tropical storm%' OR e LIKE '%tropical depression%' THEN 'tropical_storm' WHEN e LIKE '%flood%' THEN 'flood' ELSE 'other' END"""


@query(oracle(EVENTS_SQL, f"SELECT event_type, {_ALERT} AS category, count(*) AS n FROM (SELECT event_type, lower(event_type) AS e FROM storm_events) GROUP BY 1, 2"))
def p15_alert_categories(spark, d):
    return storm_events(spark, d).groupBy("event_type", alert_category("event_type").alias("category")).agg(F.count("*").alias("n"))


CATEGORIES = ("tornado", "storm_surge", "severe_thunderstorm", "hurricane", "tropical_storm", "flood", "other")


@query(oracle(EVENTS_SQL, "SELECT state, " + ", ".join(f"count(*) FILTER (WHERE c = '{c}') AS {c}" for c in CATEGORIES) + f", count(*) AS total FROM (SELECT state, {_ALERT} AS c FROM (SELECT state, lower(event_type) AS e FROM storm_events)) GROUP BY state"))
def a25_alert_counts(spark, d):
    rows = storm_events(spark, d).withColumn("c", alert_category("event_type"))
    counts = rows.groupBy("state").pivot("c", list(CATEGORIES)).count().na.fill(0)
    return counts.withColumn("total", sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0])))


@query(oracle(EVENTS_SQL, "SELECT event_id, CASE WHEN event_type IN ('Hurricane', 'Tornado', 'Tropical Storm') THEN event_type ELSE 'unknown' END AS kind FROM storm_events"))
def p16_enum_normalized(spark, d):
    return storm_events(spark, d).select("event_id", F.when(F.col("event_type").isin("Hurricane", "Tornado", "Tropical Storm"), F.col("event_type")).otherwise("unknown").alias("kind"))


RAW_SQL = """raw AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 17 = 0 THEN 'x1' ELSE o_orderkey::VARCHAR END AS policy_id, CASE WHEN o_orderkey % 19 = 0 THEN 'f' ELSE 'fl ' END AS state,
  CASE WHEN o_orderkey % 23 = 0 THEN 'abc' WHEN o_orderkey % 5 = 0 THEN '33701' WHEN o_orderkey % 7 = 0 THEN '37' ELSE '337' END AS zip3, CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 31 = 0 THEN '95' ELSE '27.5' END AS lat, '-82.5' AS lon,
  CASE WHEN o_orderkey % 37 = 0 THEN '-5' ELSE o_totalprice::BIGINT::VARCHAR END AS tiv, CASE WHEN o_orderkey % 41 = 0 THEN 'straw' ELSE 'Wood_Frame' END AS build_type, CASE WHEN o_orderkey % 43 = 0 THEN 'Q' ELSE 'ae' END AS flood_zone FROM orders)"""


def _raw(spark, d):
    k = F.col("o_orderkey")
    pick = lambda other, *pairs: (lambda out: out.otherwise(other))(_chain(pairs))
    return table(spark, d, "orders").select(
        k.alias("n"), pick(k.cast("string"), (k % 17 == 0, "x1")).alias("policy_id"), pick("fl ", (k % 19 == 0, "f")).alias("state"),
        pick("337", (k % 23 == 0, "abc"), (k % 5 == 0, "33701"), (k % 7 == 0, "37")).alias("zip3"), pick("27.5", (k % 29 == 0, ""), (k % 31 == 0, "95")).alias("lat"), F.lit("-82.5").alias("lon"),
        pick(F.rint("o_totalprice").cast("long").cast("string"), (k % 37 == 0, "-5")).alias("tiv"), pick("Wood_Frame", (k % 41 == 0, "straw")).alias("build_type"), pick("ae", (k % 43 == 0, "Q")).alias("flood_zone"),
    )


def _chain(pairs):
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out


@query(oracle(RAW_SQL, """SELECT n, lpad(left(zip3, 3), 3, '0') AS zip3, upper(trim(state)) AS state,
  CASE WHEN try_cast(policy_id AS DOUBLE) IS NULL THEN 'policy_id is not a number' WHEN lat = '' OR lon = '' THEN 'lat or lon is missing'
       WHEN try_cast(lat AS DOUBLE) NOT BETWEEN -90 AND 90 OR try_cast(lon AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'lat or lon is out of range' WHEN try_cast(tiv AS DOUBLE) <= 0 THEN 'tiv is not positive'
       WHEN NOT regexp_full_match(upper(trim(state)), '[A-Z]{2}') THEN 'state is not two letters' WHEN NOT regexp_full_match(left(zip3, 3), '[0-9]{1,3}') THEN 'zip3 is not three digits'
       WHEN lower(build_type) NOT IN ('wood_frame', 'masonry', 'manufactured') THEN 'build_type is unknown' WHEN upper(flood_zone) NOT IN ('X', 'A', 'AE', 'VE') THEN 'flood_zone is unknown' END AS error FROM raw"""))
def p1_validation(spark, d):
    return validate(_raw(spark, d)).select("n", "zip3", "state", "error")


@query(None)
def p5_mapping(spark, d):
    names = spark.createDataFrame([(c,) for c in ("Policy ID", "st", "zip_code", "Latitude", "lng", "total_tiv_usd", "construction", "fema_zone", "customer_name", "yob", "notes")], "name string")
    return suggest_mapping(names)


@query(None)
def p7_pii_columns(spark, d):
    names = spark.createDataFrame([(c,) for c in ("ssn", "SSN", "customer_name", "dob_year", "email_addr", "phone_number", "mailing_address", "policy_id", "tiv", "zip3", "build_type", "flood_zone", "state", "premium_annual", "business_name", "custSsnHash", "st1", "address1")], "name string")
    return classify_columns(names)


@query("SELECT p_partkey AS n, floor(x + 0.5)::BIGINT AS rounded FROM (SELECT p_partkey, (p_partkey % 41 - 20)::DOUBLE / 2 AS x FROM part)")
def p4_half_up(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), half_up((F.col("p_partkey") % 41 - 20) / F.lit(2.0)).alias("rounded"))


@query("""SELECT n, CASE WHEN x = '' OR try_cast(regexp_replace(x, '[KMB]$', '') AS DOUBLE) IS NULL THEN NULL ELSE round(try_cast(regexp_replace(x, '[KMB]$', '') AS DOUBLE) * CASE right(x, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END, 4) END AS dollars
 FROM (SELECT p_partkey AS n, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'bad' WHEN 2 THEN p_size::VARCHAR || 'K' WHEN 3 THEN p_size::VARCHAR || '.5M' WHEN 4 THEN p_size::VARCHAR || 'B' ELSE p_size::VARCHAR END AS x FROM part)""")
def f22_damage_strings(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 6 == 0, "").when(k % 6 == 1, "bad").when(k % 6 == 2, F.concat(s, F.lit("k"))).when(k % 6 == 3, F.concat(s, F.lit(".5M"))).when(k % 6 == 4, F.concat(s, F.lit("b"))).otherwise(s)
    return table(spark, d, "part").select(k.alias("n"), F.round(damage_dollars(text), 4).alias("dollars"))


@query(oracle(*COHORTS, """SELECT zip3, round(sum(f * policy_count) / nullif(sum(policy_count), 0), 6) AS weighted FROM (SELECT c.zip3, c.policy_count, c.policy_count % 5 + c.tiv_quintile AS f FROM cohorts c) GROUP BY zip3"""))
def a21_weighted_mean(spark, d):
    rows = C.cohorts(C.binned(policies(spark, d))).withColumn("f", F.col("policy_count") % 5 + F.col("tiv_quintile"))
    return rows.groupBy("zip3").agg(F.round(F.try_divide(F.sum(F.col("f") * F.col("policy_count")).cast("double"), F.sum("policy_count").cast("double")), 6).alias("weighted"))


@query(oracle(*BOOK, "SELECT zip3, count(*) AS policies FROM policies WHERE flood_zone = 'VE' GROUP BY zip3 ORDER BY min(id)"))
def w8_first_seen_groups(spark, d):
    rows = policies(spark, d).where("flood_zone = 'VE'").groupBy("zip3").agg(F.count("*").alias("policies"), F.min("id").alias("first"))
    return rows.orderBy("first").select("zip3", "policies")


@query(oracle(*BOOK, """SELECT zip3, least(5, floor(6 * (l - min(l) OVER ()) / nullif(max(l) OVER () - min(l) OVER (), 0)))::INT AS bucket FROM (SELECT zip3, round(log10(sum(tiv::DECIMAL(18,4))::DOUBLE), 9) AS l FROM policies GROUP BY zip3)"""))
def w14_log_buckets(spark, d):
    """Six equal steps of the logarithm of exposure; the range is one row beside one row per ZIP3."""
    rows = policies(spark, d).groupBy("zip3").agg(F.round(F.log10(money_sum("tiv")), 9).alias("l"))
    span = rows.agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    place = F.floor(F.try_divide(6 * (F.col("l") - F.col("lo")), F.col("hi") - F.col("lo")))
    return rows.join(F.broadcast(span)).select("zip3", F.least(F.lit(5), place).cast("int").alias("bucket"))


@query(oracle(EVENTS_SQL, "SELECT event_id, year, damage_property FROM storm_events WHERE year IN (2023, 2024) AND damage_property IS NOT NULL ORDER BY damage_property DESC, event_id LIMIT 5"))
def w4_costliest_events(spark, d):
    return storm_events(spark, d).where("year IN (2023, 2024) AND damage_property IS NOT NULL").orderBy(F.desc("damage_property"), "event_id").limit(5).select("event_id", "year", "damage_property")


_GEO = ", ".join(f"('{z}', '{s}', {X.NOTICE_DAYS[s]})" for z, s, *_ in X.ANCHORS)


@query(oracle(*BOOK, f"SELECT p.id, coalesce(g.days, {X.NOTICE_DEFAULT}) AS notice_days FROM policies p LEFT JOIN (VALUES {_GEO}) g(zip3, state, days) ON p.zip3 = g.zip3"))
def j7_notice_days(spark, d):
    return policies(spark, d).select("id", case_of("state", X.NOTICE_DAYS, X.NOTICE_DEFAULT).alias("notice_days"))


@query(oracle(*BOOK, EVENTS_SQL, "SELECT p.state, e.event_type, count(*) AS pairs, sum(p.tiv::DECIMAL(18,4))::DOUBLE AS exposed FROM policies p JOIN storm_events e USING (state) GROUP BY 1, 2"))
def j8_policies_by_events(spark, d):
    """Policies by the storm events of their state.  Pairs are counted and summed from the two sides'
    own aggregates, so that the many-to-many rows are never made."""
    book = policies(spark, d).groupBy("state").agg(F.count("*").alias("p"), F.sum(F.col("tiv").cast("decimal(18,4)")).alias("t"))
    storms = storm_events(spark, d).groupBy("state", "event_type").agg(F.count("*").alias("e"))
    return book.join(storms, "state").select("state", "event_type", (F.col("p") * F.col("e")).alias("pairs"), (F.col("t") * F.col("e")).cast("double").alias("exposed"))


@query(oracle(*BOOK, """SELECT id, severity, prior, CASE WHEN cur - prior > greatest(100, 0.02 * abs(cur)) THEN 'up' WHEN prior - cur > greatest(100, 0.02 * abs(cur)) THEN 'down' WHEN prior IS NULL THEN 'none' ELSE 'same' END AS change
 FROM (SELECT id, CASE WHEN build_type = 'manufactured' OR flood_zone = 'VE' THEN 'high' WHEN flood_zone = 'AE' THEN 'medium' ELSE 'low' END AS severity, tiv AS cur, CASE WHEN id % 3 = 0 THEN tiv + 150 * (id % 5 - 2) WHEN id % 3 = 1 THEN tiv * 0.9::DOUBLE END AS prior FROM policies)"""))
def f28_severity_change(spark, d):
    rows = policies(spark, d).select("id", severity_tier().alias("severity"), F.col("tiv").alias("cur"), F.when(F.col("id") % 3 == 0, F.col("tiv") + 150 * (F.col("id") % 5 - 2)).when(F.col("id") % 3 == 1, F.col("tiv") * 0.9).alias("prior"))
    band = F.greatest(F.lit(100.0), 0.02 * F.abs("cur"))
    return rows.select("id", "severity", "prior", F.when(F.col("cur") - F.col("prior") > band, "up").when(F.col("prior") - F.col("cur") > band, "down").when(F.col("prior").isNull(), "none").otherwise("same").alias("change"))


@query(oracle(*BOOK, EVENTS_SQL, """, """.strip(", ") + """SELECT event_id, id, round(damage_property * tiv / total, 6) AS realized FROM (SELECT id, state, tiv, (sum(tiv::DECIMAL(18,4)) OVER (PARTITION BY state))::DOUBLE AS total FROM policies)
 JOIN (SELECT * FROM storm_events WHERE damage_property IS NOT NULL ORDER BY damage_property DESC, event_id LIMIT 2) USING (state)"""))
def a37_realized_loss(spark, d):
    """A storm's damage dealt to the policies of its state by insured value."""
    book = policies(spark, d)
    totals = book.groupBy("state").agg(money_sum("tiv").alias("total"))
    storms = storm_events(spark, d).where("damage_property IS NOT NULL").orderBy(F.desc("damage_property"), "event_id").limit(2).select("event_id", "state", "damage_property")
    return book.join(F.broadcast(storms.join(totals, "state")), "state").select("event_id", "id", F.round(F.col("damage_property") * F.col("tiv") / F.col("total"), 6).alias("realized"))


@query("SELECT o_custkey AS key, count(*) AS n, max_by(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS last_order FROM orders GROUP BY o_custkey")
def d1_last_write_wins(spark, d):
    """Upsert: of all writes to a key the latest stays (ties by the larger id)."""
    rows = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    ranked = rows.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    return ranked.where("r = 1").select(F.col("o_custkey").alias("key"), "n", F.col("o_orderkey").alias("last_order"))
