"""Queries on loads, versions, loss artifacts and scenarios; what needs files writes them to the shared folder first, from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import cohort as C
from ..operators import scenarios as N
from ..operators.staging import shared_dir, staged
from ..sources import feeds as S
from ..sources.book_table import BookTable
from .domain import ANCHORS_SQL, BOOK, COHORTS, EVENTS_SQL, anchors, oracle, policies, storm_events, table
from .loss import _curve_sql

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(oracle(*BOOK, "SELECT id::VARCHAR AS policy_id, state, zip3, build_type, flood_zone, county, build_year::VARCHAR AS build_year, round(tiv, 2) AS tiv, round(lat, 6) AS lat, NULL::VARCHAR AS cv_features FROM policies"))
def s2_book_by_header(spark, d):
    """The book as CSV in an order of its own with a column too many and one absent, read by its header."""
    path, book = _place(spark, "book-csv"), policies(spark, d)
    text = lambda c: F.col(c).cast("string")
    out = book.select(text("tiv").alias("TIV"), "county", "flood_zone", F.lit("x").alias("note"), text("build_year").alias(" build_year"), text("lon").alias("lon"), text("lat").alias("lat"), "build_type", "zip3", "state", text("id").alias("policy_id"), text("premium_annual").alias("premium_annual"), text("elevation_m").alias("elevation_m"))
    out.write.csv(path, header=True, escape='"')
    rows = S.read_book_csv(spark, path)
    return rows.select("policy_id", "state", "zip3", "build_type", "flood_zone", "county", "build_year", F.round(F.col("tiv").cast("double"), 2).alias("tiv"), F.round(F.col("lat").cast("double"), 6).alias("lat"), "cv_features")


@query(oracle(*BOOK, """book AS (SELECT id, state, CASE WHEN id % 10 = 3 THEN -1::DOUBLE WHEN id % 5 = 3 THEN id::DOUBLE / 8 ELSE elevation_m END AS elevation_m, CASE WHEN id % 10 = 3 THEN 'z' || id ELSE flood_zone END AS flood_zone FROM policies)""", """SELECT state, count(*) AS n, sum(elevation_m::DECIMAL(18,4))::DOUBLE AS elevation, count(*) FILTER (WHERE flood_zone LIKE 'z%') AS rezoned, 3::BIGINT AS versions, (SELECT count(*) FROM policies WHERE id % 2 = 0) AS first_rows FROM book GROUP BY state"""))
def s20_book_versions(spark, d):
    """A book loaded in half, replaced by the whole one, then updated by id; the first version can still be read."""
    book = policies(spark, d).select("id", "state", "zip3", "tiv", "flood_zone", "elevation_m")
    held = BookTable(spark, _place(spark, "book"))
    first = held.replace(book.where("id % 2 = 0"))
    held.replace(book)
    own = F.col("id")
    changes = book.where("id % 5 = 3").select("id", (own / 8).alias("elevation_m"), F.lit(None).cast("string").alias("flood_zone"), F.lit(1).alias("seq"))
    later = book.where("id % 10 = 3").select("id", F.lit(-1.0).alias("elevation_m"), F.concat(F.lit("z"), own.cast("string")).alias("flood_zone"), F.lit(2).alias("seq"))
    unknown = book.limit(1).select((-own - 1).alias("id"), F.lit(7.0).alias("elevation_m"), F.lit("A").alias("flood_zone"), F.lit(3).alias("seq"))
    last = held.update(changes.unionByName(later).unionByName(unknown), order="seq")
    n_first = held.read(first).count()
    out = held.read().groupBy("state").agg(F.count("*").alias("n"), F.sum(F.col("elevation_m").cast("decimal(18,4)")).cast("double").alias("elevation"), F.sum(F.col("flood_zone").startswith("z").cast("long")).alias("rezoned"))
    return out.withColumns({"versions": F.lit(last).cast("long"), "first_rows": F.lit(n_first).cast("long")})


_ZIPS = "[" + ", ".join(f"'{a[0]}'" for a in X.ANCHORS) + "]"
SCENARIOS_SQL = f"""scenarios AS (SELECT event_id AS scenario, (60 + event_id * 37 % 140)::DOUBLE AS peak_wind, CASE WHEN event_id % 4 <> 0 THEN {_ZIPS}[user_id % 38 + 1] END AS z1, (event_id % 40)::DOUBLE / 10 AS d1, CASE WHEN event_id % 3 = 0 THEN {_ZIPS}[(user_id + 5) % 38 + 1] END AS z2, (event_id % 23)::DOUBLE / 10 AS d2 FROM events),
entries AS (SELECT scenario, z1 AS zip3, d1 AS depth FROM scenarios WHERE z1 IS NOT NULL UNION ALL SELECT scenario, z2, d2 FROM scenarios WHERE z2 IS NOT NULL)"""


def _scenarios(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    zips = F.array(*(F.lit(a[0]) for a in X.ANCHORS))
    at = lambda i: F.element_at(zips, (i % 38 + 1).cast("int"))
    one = F.when(k % 4 != 0, F.struct(at(u).alias("zip3"), ((k % 40) / F.lit(10.0)).alias("depth")))
    two = F.when(k % 3 == 0, F.struct(at(u + 5).alias("zip3"), ((k % 23) / F.lit(10.0)).alias("depth")))
    return table(spark, d, "events").select(k.alias("scenario"), (60 + k * 37 % 140).cast("double").alias("peak_wind"), F.map_from_entries(F.filter(F.array(one, two), lambda e: e.isNotNull())).alias("surge"))


def _wind_sql(w: str) -> str:
    return f"CASE build_type WHEN 'masonry' THEN {_curve_sql(w, X.WIND_CURVE['masonry'])} WHEN 'manufactured' THEN {_curve_sql(w, X.WIND_CURVE['manufactured'])} ELSE {_curve_sql(w, X.WIND_CURVE['wood_frame'])} END"


@query(oracle(*COHORTS, SCENARIOS_SQL, f"""crossed AS (SELECT c.cohort_id, total_tiv, e.zip3 IS NOT NULL AS exposed, round({_wind_sql(f"(s.peak_wind * CASE WHEN e.zip3 IS NULL THEN {N.ELSEWHERE}::DOUBLE ELSE {N.EXPOSED}::DOUBLE END)")}, 9) AS wind,
   CASE WHEN modal_zone IN ('VE', 'AE') AND depth > 0 THEN round({_curve_sql("greatest(0::DOUBLE, depth - avg_elevation)", X.SURGE_CURVE)}, 9) ELSE 0 END AS surge
  FROM cohorts c, scenarios s LEFT JOIN entries e ON e.scenario = s.scenario AND e.zip3 = c.zip3)""", """SELECT cohort_id, count(*) FILTER (WHERE exposed) AS n_exposed, round(avg(greatest(wind, surge)), 7) AS mean_ratio FROM crossed GROUP BY cohort_id"""))
def j9_scenario_damage(spark, d):
    cohorts = staged(C.cohorts(C.binned(policies(spark, d))), "cohorts")
    return N.mean_damage(cohorts, _scenarios(spark, d)).select("cohort_id", "n_exposed", F.round("mean_ratio", 7).alias("mean_ratio"))


_BY_TYPE = {"Hurricane": 110.0, "Tornado": 95.0, "Tropical Storm": 60.0}


@query(oracle(ANCHORS_SQL, EVENTS_SQL, SCENARIOS_SQL, """asked AS (SELECT event_id, state, CASE event_type WHEN 'Hurricane' THEN 110::DOUBLE WHEN 'Tornado' THEN 95 WHEN 'Tropical Storm' THEN 60 ELSE 70 END AS wind FROM storm_events WHERE year = 2024 AND damage_property IS NOT NULL),
 worst AS (SELECT scenario, (arg_min(zip3, struct_pack(d := -depth, z := zip3))) AS zip3 FROM entries GROUP BY scenario),
 states AS (SELECT s.peak_wind, a.state FROM worst JOIN scenarios s USING (scenario) JOIN (SELECT DISTINCT zip3, state FROM anchors) a ON a.zip3 = worst.zip3),
 met AS (SELECT event_id, any_value(wind) AS wind, count(peak_wind) AS matches FROM asked LEFT JOIN states ON states.state = asked.state AND abs(peak_wind - wind) <= 10 GROUP BY event_id)""", """SELECT event_id, wind, matches, round(ln(greatest(matches::DOUBLE / n, 1 / (10::DOUBLE * n))), 6) AS loglik FROM met, (SELECT count(*) AS n FROM scenarios)"""))
def a36_log_likelihood(spark, d):
    """All damaging storms of the held-out year against all scenarios."""
    kind = F.col("event_type")
    wind = F.lit(70.0)
    for name, w in _BY_TYPE.items():
        wind = F.when(kind == name, F.lit(w)).otherwise(wind)
    asked = storm_events(spark, d).where("year = 2024 AND damage_property IS NOT NULL").select("event_id", "state", wind.alias("wind"))
    scenarios = _scenarios(spark, d)
    out = N.log_likelihood(asked, scenarios, anchors(spark).select("zip3", "state").distinct(), scenarios.count())
    return out.select("event_id", "wind", "matches", F.round("loglik", 6).alias("loglik"))


def _written_sims(spark, d) -> str:
    """A loss artifact per ship date's month of 1995 to 1997 of lineitem with a few draws, each as one file of its name."""
    path = _place(spark, "sims")
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy_MM").alias("sim_id"), F.col("l_suppkey").cast("string").alias("cohort_key"), (F.col("l_linenumber") - 1).alias("k"), "l_extendedprice")
    wide = rows.groupBy("sim_id", "cohort_key").agg(*(F.coalesce(F.sum(F.when(F.col("k") == i, F.col("l_extendedprice").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias(f"k{i:04d}") for i in range(4)))
    # a file of its own name for each sim: written by sim, then every part is renamed
    wide.repartition("sim_id").write.partitionBy("sim_id").parquet(f"{path}/parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(hadoop.Path(f"{path}/parts/sim_id=*")):
        (part,) = fs.globStatus(hadoop.Path(f"{folder.getPath()}/*.parquet"))
        fs.rename(part.getPath(), hadoop.Path(f"{path}/{folder.getPath().getName().split('=')[1]}.parquet"))
    return path


_SIMS = "sims AS (SELECT strftime(l_shipdate, '%Y_%m') AS sim_id, l_suppkey::VARCHAR AS cohort_key, " + ", ".join(f"coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_linenumber = {i + 1}), 0)::DOUBLE AS k{i:04d}" for i in range(4)) + " FROM lineitem GROUP BY 1, 2)"


@query(oracle(_SIMS, "SELECT * FROM sims WHERE sim_id LIKE '%_02' OR sim_id LIKE '%_07'"))
def s15_sims_by_id(spark, d):
    path = _written_sims(spark, d)
    names = [r["sim_id"] for r in S.sim_files(spark, path).select("sim_id").collect()]
    return S.read_sims(spark, path, [n for n in names if n.endswith(("_02", "_07"))] + ["unknown"])


@query(oracle(_SIMS, "SELECT DISTINCT strftime(o_orderdate, '%Y_%m') AS sim_id FROM orders WHERE strftime(o_orderdate, '%Y_%m') NOT IN (SELECT sim_id FROM sims) UNION SELECT 'retired'"))
def j18_missing_sims(spark, d):
    """Months with orders, and one more id, that have no loss file."""
    files = S.sim_files(spark, _written_sims(spark, d))
    known = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy_MM").alias("sim_id")).distinct().unionByName(spark.createDataFrame([("retired",)], "sim_id string"))
    return S.missing_sims(known, files)
