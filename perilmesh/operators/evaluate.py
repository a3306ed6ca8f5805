"""Ex-post evaluation: profit and loss, retained tails, drift of past decisions, CRPS, staffing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import drive_hours, money_sum, retained_xs
from .assignment import MOST_PLACES, least_cost
from .decide import action_dim, dominant


def profit_and_loss(actions: DataFrame, cohorts: DataFrame, realised: DataFrame) -> DataFrame:
    """Premium collected, loss paid, cession cost and their net, for a mix and realised losses (cohort_id, realised)."""
    rows = actions.join(F.broadcast(action_dim(actions.sparkSession)), "action").groupBy("cohort_id").agg(
        F.sum(F.col("share") * F.col("premium_factor")).alias("p"), F.sum(F.col("share") * F.col("loss_factor")).alias("l"), F.sum(F.col("share") * F.col("ceded_share")).alias("c"))
    rows = rows.join(cohorts.select("cohort_id", "total_premium"), "cohort_id").join(realised, "cohort_id", "left")
    out = rows.agg(
        F.round(money_sum(F.col("total_premium") * F.col("p"), 6), 2).alias("premium_collected"),
        F.round(money_sum(F.coalesce("realised", F.lit(0.0)) * F.col("l"), 6), 2).alias("loss_paid"), F.round(money_sum(F.col("total_premium") * F.col("c"), 6), 2).alias("cession_cost"))
    return out.withColumn("net_pnl", F.round(F.col("premium_collected") - F.col("loss_paid") - F.col("cession_cost"), 2))


def retained_losses(losses: DataFrame, actions: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(cohort_id 'book', k, loss) of the book after each cohort's chosen action: its loss factor, or its excess layer."""
    dim = action_dim(losses.sparkSession).select("action", "loss_factor")
    chosen = dominant(actions).join(F.broadcast(dim), "action").join(cohorts.select("cohort_id", "loss_p50", "loss_p99"), "cohort_id")
    attach = 1.5 * F.col("loss_p50")
    layers = chosen.select("cohort_id", "action", "loss_factor", attach.alias("attach"), F.greatest(2.0 * F.col("loss_p99"), attach).alias("exhaust"))
    kept = F.when(F.col("action") == "cede_xs", retained_xs("loss", "attach", "exhaust")).otherwise(F.col("loss") * F.col("loss_factor"))
    return losses.join(layers, "cohort_id").groupBy("k").agg(money_sum(kept).alias("loss")).select(F.lit("book").alias("cohort_id"), "k", "loss")


def decision_drift(decisions: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Per decision (decision_id, cohorts_hash, now_hash, actions: cohort_id, action, share) its proposed retained loss, how many
    cohorts are gone, and whether the cohorts have drifted since."""
    dim = F.broadcast(action_dim(decisions.sparkSession).select("action", "loss_factor"))
    rows = decisions.select("decision_id", (F.col("cohorts_hash") != F.col("now_hash")).alias("drifted"), F.explode("actions").alias("a")).select("decision_id", "drifted", "a.*")
    joined = rows.join(dim, "action").join(cohorts.select("cohort_id", "loss_p50"), "cohort_id", "left")
    loss = F.coalesce(F.col("share") * F.col("loss_factor") * F.col("loss_p50"), F.lit(0.0))
    return joined.groupBy("decision_id", "drifted").agg(F.round(money_sum(loss), 2).alias("retained"), F.count_distinct(F.when(F.col("loss_p50").isNull(), F.col("cohort_id"))).alias("missing"))


def crps(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Exact CRPS of a piecewise linear distribution function through quantiles (q array at ``levels``), flat at 0 and 1 outside.

    Closed form per segment, in expressions.  The source system interpolates with a monotone cubic instead, so values differ slightly.
    """
    y, q = F.col("y"), F.col("q")
    total = F.greatest(F.lit(0.0), F.get(q, F.lit(0)) - y) + F.greatest(F.lit(0.0), y - F.get(q, F.lit(len(levels) - 1)))
    for i, (p0, p1) in enumerate(zip(levels, levels[1:])):
        a, b = F.get(q, F.lit(i)), F.get(q, F.lit(i + 1))
        at = F.least(F.greatest(y, a), b)
        py = p0 + (p1 - p0) * F.try_divide(at - a, b - a)
        below = (at - a) * (p0 * p0 + p0 * py + py * py) / 3
        above = (b - at) * ((1 - py) * (1 - py) + (1 - py) * (1 - p1) + (1 - p1) * (1 - p1)) / 3
        total = total + F.when(b > a, below + above).otherwise(0.0)
    return rows.withColumn("crps", total)


def feasible_assignments(adjusters: DataFrame, zones: DataFrame, max_hours: float = 8.0) -> DataFrame:
    """(adjuster_id, zone_id, hours) for zones whose skill the adjuster has, within ``max_hours`` of driving.

    Adjusters are few and so are zones: the zones are the small side.
    """
    hours = drive_hours("home_lat", "home_lon", "lat", "lon")
    pairs = adjusters.join(F.broadcast(zones), F.col("required_skill").isNull() | F.array_contains("skills", F.col("required_skill")))
    return pairs.withColumn("hours", F.round(hours, 4)).where(F.col("hours") <= max_hours)


def assign(adjusters: DataFrame, zones: DataFrame, *, max_hours: float = 8.0) -> DataFrame:
    """One zone per adjuster and day, at most ``capacity`` adjusters per zone, least in total of hours times expected claims (to 6 digits).

    As many adjusters as can be are placed; where some are left out (they aren't listed) the source system calls the whole problem
    infeasible.  All days are alike, so one day is solved.  Zones are a small side (``assignment.MOST_PLACES``).
    Returns (adjuster_id, zone_id, hours, cost).
    """
    pairs = feasible_assignments(adjusters, zones, max_hours).select(F.col("adjuster_id").alias("who"), F.col("zone_id").alias("place"), "hours", F.round(F.col("hours") * F.col("expected_claim_volume"), 6).alias("exact"))
    pairs = pairs.withColumn("cost", F.round(F.col("exact") * 1_000_000).cast("long"))
    room = {r["zone_id"]: r["capacity"] for r in zones.select("zone_id", "capacity").limit(MOST_PLACES + 1).collect()}
    chosen = least_cost(pairs, room).select("who", "place")
    return pairs.join(chosen, ["who", "place"]).select(F.col("who").alias("adjuster_id"), F.col("place").alias("zone_id"), "hours", F.col("exact").alias("cost"))
