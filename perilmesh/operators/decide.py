"""Decisions: action mixes in long form (cohort_id, action, share), the optimizer and the reconciler."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import case_of, money_sum, territory


def action_dim(spark) -> DataFrame:
    """One row per action: order, premium and loss factors, cession cost and ceded share of premium."""
    rows = []
    for i, a in enumerate(X.ACTIONS):
        change = X.RATE_CHANGE.get(a)
        premium = 0.0 if a == "non_renew" else 0.5 if a == "cede_qs" else 1.0 if change is None else (1 + change) * (1 - X.ELASTICITY * max(change, 0.0))
        loss = {"non_renew": 0.0, "cede_qs": 0.5}.get(a, 1.0)
        rows.append((i, a, premium, loss, X.CESSION_COST.get(a, 0.0), X.CEDED_SHARE.get(a, 0.0)))
    return spark.createDataFrame(rows, "action_idx int, action string, premium_factor double, loss_factor double, cession_cost double, ceded_share double")


def dominant(actions: DataFrame) -> DataFrame:
    """(cohort_id, action, share): the action with the largest share, the first in order at ties."""
    rows = actions.join(F.broadcast(action_dim(actions.sparkSession).select("action", "action_idx")), "action")
    best = F.max_by(F.struct("action", "share"), F.struct("share", -F.col("action_idx")))
    return rows.groupBy("cohort_id").agg(best.alias("b")).select("cohort_id", "b.action", "b.share")


def action_summary(actions: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Cohorts and insured value by dominant action; all actions are listed."""
    dim = action_dim(actions.sparkSession).select("action")
    own = dominant(actions).join(cohorts.select("cohort_id", "total_tiv"), "cohort_id").groupBy("action").agg(F.count("*").alias("n"), money_sum("total_tiv").alias("tiv"))
    return dim.join(own, "action", "left").select("action", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("tiv", F.lit(0.0)).alias("tiv"))


def apply_pins(actions: DataFrame, pins: DataFrame, policy_cohorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stamps of all pins on known policies, and the actions with the last pin of each cohort in force.

    pins: (policy_id, pinned_action, seq).  A stamp's original action is that of the pin before it, else the dominant one.
    """
    known = pins.join(policy_cohorts.select(F.col("id").alias("policy_id"), "cohort_id"), "policy_id").join(dominant(actions).select("cohort_id", F.col("action").alias("was")), "cohort_id")
    w = Window.partitionBy("cohort_id").orderBy("seq")
    stamps = known.select("cohort_id", "policy_id", "pinned_action", "seq", F.coalesce(F.lag("pinned_action").over(w), "was").alias("original_action"))
    last = stamps.groupBy("cohort_id").agg(F.max_by("pinned_action", "seq").alias("pinned"))
    kept = actions.join(last, "cohort_id", "left_anti")
    return stamps, kept.unionByName(last.select("cohort_id", F.col("pinned").alias("action"), F.lit(1.0).alias("share")))


def non_renewed(actions: DataFrame) -> DataFrame:
    return actions.where((F.col("action") == "non_renew") & (F.col("share") > X.NONRENEW_THRESHOLD)).select("cohort_id", "share")


def territory_caps(cohorts: DataFrame, bucket_totals: DataFrame) -> DataFrame:
    """Cohorts (cohort_id, zip3, state, total_tiv) whose non-renewal is deferred by the cap of their territory.

    Smallest first until the rest is within the cap: a cohort is deferred exactly if the total less
    what stands before it exceeds the cap.  One window per territory.
    """
    rows = cohorts.withColumn("bucket", territory("zip3", "state")).join(F.broadcast(bucket_totals), "bucket", "left")
    tiv = F.col("total_tiv").cast("decimal(18,4)")
    every = Window.partitionBy("bucket")
    before = Window.partitionBy("bucket").orderBy("total_tiv", "cohort_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum(tiv).over(every).cast("double")).withColumn("before", F.coalesce(F.sum(tiv).over(before).cast("double"), F.lit(0.0)))
    rows = rows.withColumn("denom", F.coalesce("bucket_tiv", "total")).withColumn("cap", case_of("bucket", X.CAPS, X.CAPS["__default__"]))
    return rows.where((F.col("denom") > 0) & (F.col("total") - F.col("before") > F.col("cap") * F.col("denom"))).select("cohort_id", "bucket", "cap", F.round(F.col("total") / F.col("denom"), 9).alias("observed"))


def notice_deferrals(cohorts: DataFrame, today: Column) -> DataFrame:
    """Non-renewed cohorts (cohort_id, state, renewal date) whose renewal is nearer than the notice period allows.

    They move to the renewal a year later; a 29 February becomes 1 March.
    """
    renewal = F.coalesce("renewal", F.date_add(today, 365))
    rows = cohorts.select("cohort_id", "state", renewal.alias("renewal")).withColumn("days", F.datediff("renewal", today)).withColumn("notice", case_of("state", X.NOTICE_DAYS, X.NOTICE_DEFAULT))
    leap = (F.month("renewal") == 2) & (F.dayofmonth("renewal") == 29)
    return rows.where("days < notice").select("cohort_id", "days", "notice", F.when(leap, F.date_add(F.add_months("renewal", 12), 1)).otherwise(F.add_months("renewal", 12)).alias("deferred_to"))


def coefficients(cohorts: DataFrame) -> DataFrame:
    """Profit, capital, cession and non-renewal coefficients of every (cohort, action)."""
    rows = cohorts.join(F.broadcast(action_dim(cohorts.sparkSession)))
    capital = F.col("loss_p99") * F.col("loss_factor")
    attach, exhaust = 1.5 * F.col("loss_p50"), 2.0 * F.col("loss_p99")
    capital = F.when(F.col("action") == "cede_xs", F.least("loss_p99", attach) + F.greatest(F.lit(0.0), F.col("loss_p99") - exhaust)).otherwise(capital)
    profit = F.col("total_premium") * F.col("premium_factor") - F.col("loss_p50") * F.col("loss_factor") - F.col("loss_p50") * F.col("cession_cost")
    return rows.select("cohort_id", "action", "action_idx", profit.alias("profit"), capital.alias("capital"), (F.col("total_premium") * F.col("ceded_share")).alias("cession"), F.when(F.col("action") == "non_renew", F.col("total_tiv")).otherwise(0.0).alias("nonrenew"))


def best_actions(coef: DataFrame, on_capital: float, on_cession: float, on_nonrenew: float) -> DataFrame:
    """Per cohort the action with the highest profit less priced resources; the first in order at ties."""
    score = F.col("profit") - on_capital * F.col("capital") - on_cession * F.col("cession") - on_nonrenew * F.col("nonrenew")
    pick = F.max_by(F.struct("action", "profit", "capital", "cession", "nonrenew"), F.struct(F.round(score, 6), -F.col("action_idx")))
    return coef.groupBy("cohort_id").agg(pick.alias("p")).select("cohort_id", "p.*")


@dataclass
class Solution:
    status: str
    objective: float | None
    prices: tuple[float, float, float]
    actions: DataFrame


def solve(cohorts: DataFrame, *, capital: float, nonrenew_share: float, cession: float, rounds: int = 25, tolerance: float = 1e-3) -> Solution:
    """Choose one action per cohort under budgets for capital, cession and non-renewed value.

    Given prices on the three budgets the cohorts decouple, so each round is one aggregation, and three sums
    come to the driver.  Prices follow the excess (subgradient with a shrinking relative
    step); the most profitable choice within all budgets is kept.  The coefficient table is checkpointed once.
    status is Optimal if a feasible choice is within ``tolerance`` of the dual bound, Feasible
    if there is one.  Else (objective None) it is Infeasible if the choice that uses least of a budget
    exceeds that budget, and Undecided if not: then no round happened to meet all three.
    """
    coef = coefficients(cohorts).persist()
    tiv = cohorts.agg(money_sum("total_tiv")).first()[0] or 0.0
    budgets = (capital, cession, nonrenew_share * tiv)
    prices, best, bound = [0.0, 0.0, 0.0], None, float("inf")
    scale = coef.agg(F.sum(F.abs("profit")), F.sum("capital"), F.sum("cession"), F.sum("nonrenew")).first()
    unit = [(scale[0] or 1.0) / max(scale[i + 1] or 1.0, 1e-9) for i in range(3)]
    for n in range(rounds):
        chosen = best_actions(coef, *prices)
        profit, *used = (x or 0.0 for x in chosen.agg(*(money_sum(c) for c in ("profit", "capital", "cession", "nonrenew"))).first())
        bound = min(bound, profit - sum(p * (u - b) for p, u, b in zip(prices, used, budgets)))
        if all(u <= b * (1 + 1e-12) for u, b in zip(used, budgets)) and (best is None or profit > best[0]):
            best = (profit, tuple(prices))
        if best and bound - best[0] <= tolerance * max(1.0, abs(bound)):
            break
        step = 2.0 / (n + 1)
        prices = [max(0.0, p + step * m * (u - b) / max(b, u, 1e-9)) for p, m, u, b in zip(prices, unit, used, budgets)]
    if best is None:
        zero = cohorts.select("cohort_id", F.lit(None).cast("string").alias("action"))
        each = coef.groupBy("cohort_id").agg(*(F.min(c).alias(c) for c in ("capital", "cession", "nonrenew")))
        fewest = [x or 0.0 for x in each.agg(*(money_sum(c) for c in ("capital", "cession", "nonrenew"))).first()]
        proven = any(u > b * (1 + 1e-12) for u, b in zip(fewest, budgets))
        return Solution("Infeasible" if proven else "Undecided", None, tuple(prices), zero)
    status = "Optimal" if bound - best[0] <= tolerance * max(1.0, abs(bound)) else "Feasible"
    return Solution(status, best[0], best[1], best_actions(coef, *best[1]).select("cohort_id", "action"))


def solve_relaxed(cohorts: DataFrame, *, capital: float, factor: float = 1.5, **budgets) -> tuple[Solution, float | None]:
    """The solution, and if no choice within the budgets was found that of ``factor`` times the capital: once, marked Infeasible_relaxed.

    The retry also follows Undecided, which proves nothing.  Returns the solution and the factor that was used (None if none was needed).
    """
    found = solve(cohorts, capital=capital, **budgets)
    if found.objective is not None:
        return found, None
    again = solve(cohorts, capital=capital * factor, **budgets)
    if again.objective is None:
        return again, factor
    return Solution("Infeasible_relaxed", again.objective, again.prices, again.actions), factor


def replications(cohorts: DataFrame, *, draws: int, times: int, capital: float, **budgets) -> DataFrame:
    """(replication, status, x): the objective x of each of ``times`` samples of ``draws`` losses per cohort, each with draws of its own.

    ``calibrate.envelope`` summarises them.  The tails of a replication take the place of the cohorts' own.
    """
    from .loss import prior_losses, tails

    if times < 2:
        raise ValueError("a spread needs at least two replications")
    rows = []
    for r in range(times):
        own = tails(prior_losses(cohorts, draws, stream=10 + r)).select("cohort_id", F.col("p50").alias("loss_p50"), F.col("tvar").alias("loss_p99"))
        found = solve(cohorts.drop("loss_p50", "loss_p99").join(own, "cohort_id"), capital=capital, **budgets)
        rows.append((r, found.status, found.objective))
    return cohorts.sparkSession.createDataFrame(rows, "replication int, status string, x double")
