"""Cohorts under storm scenarios, and scenarios against what happened.

A scenario is (scenario, peak_wind, surge: map of zip3 to depth in metres).  Surge maps name few of all
zip3s, so a cohort's sum over scenarios is taken as the total of all scenarios by the wind far from surge, less that of the
scenarios which name its zip3, plus what these do to it: only named (zip3, scenario) pairs become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import surge_damage, wind_damage

#: Share of the peak wind at properties in a zip3 with surge, and elsewhere.
EXPOSED, ELSEWHERE = 0.85, 0.30
_SURGE_ZONES = ("VE", "AE")


def _sum(value: Column) -> Column:
    return F.sum(F.round(value, 9).cast("decimal(28,9)"))


def exposed_pairs(scenarios: DataFrame) -> DataFrame:
    """(zip3, scenario, peak_wind, depth) of the entries of surge maps; a null depth is 0."""
    named = scenarios.select("scenario", "peak_wind", F.explode("surge").alias("zip3", "depth"))
    return named.withColumn("depth", F.coalesce("depth", F.lit(0.0)))


def mean_damage(cohorts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(cohort_id, n_exposed, mean_ratio, mean_loss): the mean damage ratio of each cohort over all scenarios.

    cohorts: (cohort_id, zip3, build_type, modal_zone, avg_elevation, total_tiv).  A ratio is the larger of wind's and, in coastal
    flood zones, of surge's.  Scenarios are one row each; without scenarios there are no rows.
    """
    far = F.col("peak_wind") * ELSEWHERE
    # by wind, so that scenarios shrink to their distinct winds before they meet the build types (there are three curves)
    winds = scenarios.groupBy("peak_wind").agg(F.count("*").alias("times"))
    default = winds.withColumn("build_type", F.explode(F.array(*map(F.lit, X.WIND_CURVE))))
    totals = default.groupBy("build_type").agg(_sum(wind_damage(far, "build_type") * F.col("times")).alias("total"), F.sum("times").alias("n"))
    met = cohorts.join(exposed_pairs(scenarios), "zip3")
    near = wind_damage(F.col("peak_wind") * EXPOSED, "build_type")
    surge = F.when(F.col("modal_zone").isin(*_SURGE_ZONES) & (F.col("depth") > 0), surge_damage("depth", "avg_elevation")).otherwise(0.0)
    changed = met.groupBy("cohort_id").agg(_sum(F.greatest(near, surge)).alias("exact"), _sum(wind_damage(far, "build_type")).alias("instead"), F.count("*").alias("n_exposed"))
    curve = F.when(F.col("build_type").isin(*X.WIND_CURVE), F.col("build_type")).otherwise("wood_frame")  # as wind_damage takes others
    rows = cohorts.withColumn("_curve", curve).join(F.broadcast(totals.withColumnRenamed("build_type", "_curve")), "_curve").join(changed, "cohort_id", "left")
    none = F.lit(0).cast("decimal(38,9)")
    mean = (F.col("total") - F.coalesce("instead", none) + F.coalesce("exact", none)).cast("double") / F.col("n")
    return rows.select("cohort_id", F.coalesce("n_exposed", F.lit(0)).alias("n_exposed"), mean.alias("mean_ratio"), (mean * F.col("total_tiv")).alias("mean_loss"))


def scenario_states(scenarios: DataFrame, zip3_states: DataFrame) -> DataFrame:
    """Scenarios with the state of the zip3 of their highest surge (the first by name at ties); those without surge, or of an unknown zip3, go."""
    worst = F.array_min(F.transform(F.map_entries("surge"), lambda e: F.struct((-F.coalesce(e["value"], F.lit(0.0))).alias("depth"), e["key"].alias("zip3"))))["zip3"]
    return scenarios.withColumn("zip3", worst).join(zip3_states.select("zip3", "state"), "zip3")


def log_likelihood(events: DataFrame, scenarios: DataFrame, zip3_states: DataFrame, n_scenarios: int, *, within: int = 10) -> DataFrame:
    """``events`` (event_id, state, wind) with matches, match_prob and loglik among ``n_scenarios`` scenarios.

    A scenario matches if its state is the event's and its peak wind at most ``within`` from the event's wind.  A share below a tenth
    of a scenario counts as that.  Scenarios are counted by state and wind and met by bands of winds, so no event meets all of its state's.
    """
    band = lambda w: F.floor(w / F.lit(2 * within))
    counted = scenario_states(scenarios, zip3_states).groupBy("state", "peak_wind").agg(F.count("*").alias("n")).withColumn("band", band(F.col("peak_wind")))
    asked = events.withColumn("band", F.explode(F.array_distinct(F.array(band(F.col("wind") - within), band(F.col("wind")), band(F.col("wind") + within)))))
    met = asked.join(counted, ["state", "band"]).where(F.abs(F.col("peak_wind") - F.col("wind")) <= within).groupBy("event_id").agg(F.sum("n").alias("matches"))
    out = events.join(met, "event_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    p = F.col("matches") / F.lit(float(n_scenarios))
    return out.withColumns({"match_prob": p, "loglik": F.log(F.greatest(p, F.lit(1.0 / (10.0 * n_scenarios))))})
