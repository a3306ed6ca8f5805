"""The domain's tables as projections of the driver's tables, for Spark and for the oracle's SQL.

Only integer arithmetic and given values are used, so that both engines see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import case_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(X.ANCHORS)], "i int, zip3 string, state string, county string, alat double, alon double")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy book: one policy per order."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    c, z = F.col("o_custkey") % 20, (k * 7) % 20
    build = F.when(c < 11, "wood_frame").when(c < 17, "masonry").otherwise("manufactured")
    zone = F.when(z < 11, "X").when(z < 15, "A").when(z < 19, "AE").otherwise("VE")
    book = o.select(
        k.alias("id"), F.col("o_totalprice").alias("tiv"), (k % 38).cast("int").alias("i"), build.alias("build_type"), zone.alias("flood_zone"),
        (1950 + k % 70).alias("build_year"), F.when(k % 11 != 0, (k % 97) / F.lit(4.0)).alias("elevation_m"),
        F.when(k % 13 == 0, None).when(k % 13 == 1, "bad").otherwise(F.concat(F.lit("["), F.array_join(F.array(*((k * m % 8).cast("string") for m in range(1, 9))), ","), F.lit("]"))).alias("cv_features"),
        ((k * 13 % 361 - 180) / F.lit(1000.0)).alias("dlat"), ((k * 17 % 361 - 180) / F.lit(1000.0)).alias("dlon"),
    )
    rate = case_of("state", X.HO3_RATE) + case_of("flood_zone", X.FLOOD_LOADING)
    placed = book.join(F.broadcast(anchors(spark)), "i")
    return placed.select(
        "id", "state", "zip3", "county", (F.col("alat") + F.col("dlat")).alias("lat"), (F.col("alon") + F.col("dlon")).alias("lon"), "tiv", "build_year", "build_type", "flood_zone",
        "elevation_m", (F.col("tiv") * rate * case_of("build_type", X.BUILD_LOADING)).alias("premium_annual"), "cv_features",
    )


def storm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One storm event per event; damage is missing for every seventh."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"), (2018 + e % 7).alias("year"), F.element_at(F.array(*map(F.lit, ("FL", "TX", "LA", "NC"))), (F.col("user_id") % 4 + 1).cast("int")).alias("state"),
        F.when(F.col("event_type") == "click", "Hurricane").when(F.col("event_type") == "error", "Tornado").when(F.col("event_type") == "purchase", "Storm Surge/Tide").when(F.col("event_type") == "signup", "Tropical Storm").otherwise("other").alias("event_type"),
        F.when(e % 7 != 3, F.col("value") * 1000).alias("damage_property"), F.col("ts"),
    )


def _case(column: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in values.items()) + f" ELSE {other} END"


#: The same tables for the oracle, as the start of a query.
ANCHORS_SQL = "anchors(i, zip3, state, county, alat, alon) AS (VALUES " + ", ".join(f"({i}, '{z}', '{s}', '{c}', {a!r}::DOUBLE, {o!r}::DOUBLE)" for i, (z, s, c, a, o) in enumerate(X.ANCHORS)) + ")"
POLICIES_SQL = f"""policies AS (
  SELECT id, state, zip3, county, alat + dlat AS lat, alon + dlon AS lon, tiv, build_year, build_type, flood_zone, elevation_m,
         tiv * ({_case("state", X.HO3_RATE)} + {_case("flood_zone", X.FLOOD_LOADING)}) * {_case("build_type", X.BUILD_LOADING)} AS premium_annual, cv_features
  FROM (SELECT o_orderkey AS id, o_totalprice AS tiv, o_orderkey % 38 AS i,
               CASE WHEN o_custkey % 20 < 11 THEN 'wood_frame' WHEN o_custkey % 20 < 17 THEN 'masonry' ELSE 'manufactured' END AS build_type,
               CASE WHEN o_orderkey * 7 % 20 < 11 THEN 'X' WHEN o_orderkey * 7 % 20 < 15 THEN 'A' WHEN o_orderkey * 7 % 20 < 19 THEN 'AE' ELSE 'VE' END AS flood_zone,
               1950 + o_orderkey % 70 AS build_year, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 97)::DOUBLE / 4 END AS elevation_m,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 'bad'
                    ELSE '[' || concat_ws(',', {", ".join(f"o_orderkey * {m} % 8" for m in range(1, 9))}) || ']' END AS cv_features,
               (o_orderkey * 13 % 361 - 180)::DOUBLE / 1000 AS dlat, (o_orderkey * 17 % 361 - 180)::DOUBLE / 1000 AS dlon
        FROM orders) o JOIN anchors USING (i))"""
EVENTS_SQL = """storm_events AS (
  SELECT event_id, 2018 + event_id % 7 AS year, ['FL', 'TX', 'LA', 'NC'][user_id % 4 + 1] AS state,
         CASE event_type WHEN 'click' THEN 'Hurricane' WHEN 'error' THEN 'Tornado' WHEN 'purchase' THEN 'Storm Surge/Tide' WHEN 'signup' THEN 'Tropical Storm' ELSE 'other' END AS event_type,
         CASE WHEN event_id % 7 <> 3 THEN value * 1000 END AS damage_property, ts
  FROM events)"""
#: Cuts at the quintiles, bins (a value equal to a cut goes up), cohort ids.
COHORTED_SQL = """cuts AS (SELECT quantile_cont(tiv, 0.2) AS c1, quantile_cont(tiv, 0.4) AS c2, quantile_cont(tiv, 0.6) AS c3, quantile_cont(tiv, 0.8) AS c4 FROM policies),
binned AS (SELECT *, zip3 || '_' || build_type || '_q' || q AS cohort_id
           FROM (SELECT p.*, (c1 <= tiv)::INT + (c2 <= tiv)::INT + (c3 <= tiv)::INT + (c4 <= tiv)::INT AS q FROM policies p, cuts))"""
COHORTS_SQL = f"""cohorts AS (
  SELECT *, total_tiv * {X.BASE_RATE}::DOUBLE * {_case("modal_zone", X.ZONE_SEVERITY)} * {_case("build_type", X.BUILD_VULNERABILITY)} * greatest(0.7::DOUBLE, 1 - 0.05::DOUBLE * greatest(0, avg_elevation)) AS loss_p50
  FROM (SELECT cohort_id, any_value(zip3) AS zip3, any_value(state) AS state, any_value(build_type) AS build_type, any_value(q) AS tiv_quintile, count(*) AS policy_count,
               sum(tiv::DECIMAL(18,4))::DOUBLE AS total_tiv, sum(coalesce(premium_annual, 0)::DECIMAL(18,9))::DOUBLE AS total_premium, coalesce(avg(elevation_m::DECIMAL(18,4)), 0)::DOUBLE AS avg_elevation
        FROM binned GROUP BY cohort_id) c
  JOIN (SELECT cohort_id, flood_zone AS modal_zone FROM (SELECT cohort_id, flood_zone, row_number() OVER (PARTITION BY cohort_id ORDER BY count(*) DESC, flood_zone) AS r FROM binned GROUP BY cohort_id, flood_zone) WHERE r = 1) m USING (cohort_id))"""


def oracle(*parts: str) -> str:
    """A query from CTEs and a final SELECT."""
    *ctes, last = parts
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + last


BOOK = (ANCHORS_SQL, POLICIES_SQL)
COHORTED = (*BOOK, COHORTED_SQL)
COHORTS = (*COHORTED, COHORTS_SQL)
