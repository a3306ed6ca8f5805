"""Checks of what users enter (footprints, pins, budgets, ids) and the states that follow from logged moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from .decide import apply_pins, non_renewed, notice_deferrals, territory_caps
from .staging import staged


def footprint_fault(ring: Column, peril: Column, width_m: Column, epicenter: Column, level: Column, number: Column) -> Column:
    """Why a footprint is refused, or null: the first of ring, closed, width, epicenter, severity.

    ring is an array of structs; a severity is a number in the peril's scale where that is continuous, else one of its levels.
    """
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    low = F.element_at(F.create_map(*(F.lit(x) for p, (a, _) in X.SCALE_RANGE.items() for x in (p, a))), peril)
    high = F.element_at(F.create_map(*(F.lit(x) for p, (_, b) in X.SCALE_RANGE.items() for x in (p, b))), peril)
    levels = F.element_at(F.create_map(*(x for p, names in X.LEVELS.items() for x in (F.lit(p), F.array(*map(F.lit, names))))), peril)
    fits = F.when(low.isNotNull(), F.coalesce(number.between(low, high), F.lit(False))).otherwise(F.coalesce(F.array_contains(levels, level), F.lit(False)))
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "ring").when(first != last, "closed")
        .when((peril == "tornado") & ~F.coalesce(width_m > 0, F.lit(False)), "width").when((peril == "earthquake") & epicenter.isNull(), "epicenter").when(~fits, "severity")
    )


def pin_fault(action: Column, operator: Column, rationale: Column) -> Column:
    """Why a pin is refused, or null."""
    return F.when(~F.coalesce(action.isin(*X.ACTIONS), F.lit(False)), "action").when(F.length(F.trim(F.coalesce(operator, F.lit("")))) == 0, "operator").when(F.length(F.trim(F.coalesce(rationale, F.lit("")))) < 10, "rationale")


def budget_fault(capital: Column, nonrenew: Column, cession: Column) -> Column:
    """Why budgets are refused, or null: amounts are positive and finite, the share lies in 0 to 1."""
    amount = lambda x: F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))
    return F.when(~amount(capital), "capital_budget").when(~F.coalesce(nonrenew.between(0, 1), F.lit(False)), "max_nonrenew_pct").when(~amount(cession), "cession_budget")


def is_decision_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def reversals(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """State of each of ``decisions`` (id, notices_sent) after ``requests`` (id, reversed_by, ts, seq) to reverse it.

    The first request with a name counts and keeps its attribution; later ones change nothing.  Requests without
    a name or for unknown ids are left out.  Returns id, reversed_by, reversed_at, repeats and manual (notices had gone out).
    The first request of an id is found by partial aggregation, so an id with most of the requests is no hot spot.
    """
    named = requests.where(F.length(F.trim("reversed_by")) > 0)
    first = named.groupBy("id").agg(F.min_by(F.struct(F.trim("reversed_by").alias("reversed_by"), F.col("ts").alias("reversed_at")), F.struct("ts", "seq")).alias("first"), (F.count("*") - 1).alias("repeats"))
    out = decisions.join(first, "id", "left")
    return out.select("id", "first.reversed_by", "first.reversed_at", F.coalesce("repeats", F.lit(0)).alias("repeats"), (F.col("first").isNotNull() & F.col("notices_sent")).alias("manual"))


def simulation_states(moves: DataFrame) -> DataFrame:
    """State of each simulation after its ``moves`` (id, seq, move): draft, promoted or retired.

    A retired one cannot be promoted: such moves are refused and counted.  Returns id, state, promotions, refused.
    Only counts and minima are taken, so no simulation's moves are gathered.
    """
    ends = moves.groupBy("id").agg(F.min(F.when(F.col("move") == "retire", F.col("seq"))).alias("retired"))
    joined = moves.join(ends, "id")
    late = F.coalesce(F.col("seq") > F.col("retired"), F.lit(False))
    counted = joined.groupBy("id").agg(F.max("retired").alias("retired"), F.count(F.when((F.col("move") == "promote") & ~late, 1)).alias("promotions"), F.count(F.when((F.col("move") == "promote") & late, 1)).alias("refused"))
    return counted.select("id", F.when(F.col("retired").isNotNull(), "retired").when(F.col("promotions") > 0, "promoted").otherwise("draft").alias("state"), "promotions", "refused")


def relevant_storm(storms: DataFrame, *keys: str, lat: float = 28.0, lon: float = -82.0) -> DataFrame:
    """The storm of each key (of all, without keys) with the highest class, then intensity, then the least distance in degrees, then id."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in X.STORM_RANK.items() for x in kv)), F.col("classification")), F.lit(-1))
    away = F.coalesce(F.hypot(F.col("latitude") - lat, F.col("longitude") - lon), F.lit(float("inf")))
    order = F.struct(-rank, -F.coalesce("intensity_kt", F.lit(0.0)), away, "id")
    return storms.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in storms.columns if c not in keys)), order).alias("s")).select(*keys, "s.*")


def in_capsule(lat: Column, lon: Column, path: list[tuple[float, float]], width_km: float) -> Column:
    """Whether a place lies within half the width of a line of (lat, lon) points, in plane kilometres around the place."""
    y, x = F.lit(111.195), F.lit(111.195) * F.cos(F.radians(lat))
    near = []
    for (a0, o0), (a1, o1) in zip(path, path[1:]):
        px, py, qx, qy = (F.lit(o0) - lon) * x, (F.lit(a0) - lat) * y, (F.lit(o1) - lon) * x, (F.lit(a1) - lat) * y
        dx, dy = qx - px, qy - py
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / (dx * dx + dy * dy)))
        near.append(F.hypot(px + t * dx, py + t * dy))
    return (F.least(*near) if len(near) > 1 else near[0]) <= width_km / 2


@dataclass
class Reconciled:
    """What the passes leave: actions in force, stamps of what was changed and why, preflags, zone demand, conflicts and notifications."""

    actions: DataFrame  # (cohort_id, action, share)
    stamps: DataFrame  # (cohort_id, kind, original_action, value, detail)
    preflags: DataFrame
    demand: DataFrame  # (zone_id, demand)
    conflicts: DataFrame  # (cohort_id, zone_id, staff)
    notifications: DataFrame  # (cohort_id, action, policy_count, total_tiv, stamps)


def reconcile(actions: DataFrame, cohorts: DataFrame, *, pins: DataFrame, policy_cohorts: DataFrame, preflags: DataFrame, zones: DataFrame, staff: DataFrame, renewals: DataFrame, bucket_totals: DataFrame, today: Column) -> Reconciled:
    """The passes in order, each on what the ones before left.

    1. pins (policy_id, pinned_action, seq) replace the action of their cohort; 2. preflag entries (with cohort_id) of cohorts non-renewed
    by more than half go; 3. a staffed zone's demand is the mean retained share of the cohorts in its zip3; 4. non-renewed cohorts in zones
    with many adjuster-days are conflicts; 5. non-renewals (renewals: cohort_id, renewal) too near for the notice period move to the next renewal;
    6. of the others, per territory, the smallest are held back until the rest is within the cap; 7. each non-renewed cohort gets one
    notification: capped before deferred before plain, with all its stamps.

    cohorts: (cohort_id, zip3, state, total_tiv, policy_count); zones: (zone_id, zip3); staff: (zone_id, staff).  Unknown pins are left out, preflags of
    unknown cohorts stay, and a cohort without a renewal date renews in a year.
    """
    pin_stamps, pinned = apply_pins(actions, pins, policy_cohorts)
    pin_stamps, pinned = staged(pin_stamps, "pin-stamps"), staged(pinned, "pinned")  # each pass reads what the one before left
    leaving = staged(non_renewed(pinned).join(cohorts, "cohort_id"), "leaving")
    kept = preflags.join(leaving, "cohort_id", "left_anti")
    ceded = F.coalesce(F.sum(F.when(F.col("action").isin("cede_qs", "cede_xs"), F.col("share"))), F.lit(0.0))
    retained = pinned.groupBy("cohort_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ceded)).alias("retained")).join(cohorts.select("cohort_id", "zip3"), "cohort_id")
    by_zip3 = retained.groupBy("zip3").agg(F.avg("retained").alias("demand"))
    demand = zones.join(staff, "zone_id", "left_semi").join(by_zip3, "zip3").select("zone_id", "demand")
    conflicts = leaving.join(zones, "zip3").join(staff.where(F.col("staff") >= X.STAFFED), "zone_id").select("cohort_id", "zone_id", "staff")
    dated = leaving.select("cohort_id", "state").join(renewals.select("cohort_id", "renewal"), "cohort_id", "left")
    notices = staged(notice_deferrals(dated, today), "notices")
    capped = staged(territory_caps(leaving.join(notices, "cohort_id", "left_anti"), bucket_totals), "capped")
    stamp = lambda df, kind, original, value, detail: df.select("cohort_id", F.lit(kind).alias("kind"), original.alias("original_action"), F.col(value).cast("double").alias("value"), detail.cast("string").alias("detail"))
    gone = F.lit("non_renew")
    stamps = (
        stamp(pin_stamps, "pin", F.col("original_action"), "policy_id", F.col("pinned_action"))
        .unionByName(stamp(notices, "non_renew_next_renewal", gone, "days", F.col("deferred_to")))
        .unionByName(stamp(capped, "non_renew_capped", gone, "observed", F.col("bucket")))
    )
    # a cohort's stamps are its pins, one notice and one cap at most; only their kinds are gathered
    kinds = stamps.groupBy("cohort_id").agg(F.count("*").alias("stamps"), F.max(F.col("kind") == "non_renew_capped").alias("cap"), F.max(F.col("kind") == "non_renew_next_renewal").alias("notice"))
    final = F.when(F.col("cap"), "non_renew_capped").when(F.col("notice"), "non_renew_next_renewal").otherwise(gone)
    told = leaving.join(kinds, "cohort_id", "left").select("cohort_id", final.alias("action"), "policy_count", "total_tiv", F.coalesce("stamps", F.lit(0)).alias("stamps"))
    return Reconciled(pinned, stamps, kept, demand, conflicts, told)
