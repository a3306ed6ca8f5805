"""Search for portfolios under three budgets: prices by a shrinking grid, then repair and improvement by grouped gains.

Many problems (budgets) are searched at once.  Given prices on the budgets the cohorts decouple, so one job
values all trial prices of all problems: a cohort picks its best action for each, and only sums per trial come to the driver.  The
lowest dual value bounds every portfolio from above.  From the best prices of a problem several starts go on:

* repair: while a budget is exceeded, each cohort names its cheapest move that relieves it.  Moves are grouped by the price they ask
  (logarithmic bins), the groups' sums come to the driver, and the cheapest groups that suffice are taken;
* improvement: while there is room, each cohort names its most profitable move that fits, grouped and taken likewise, dearest last;
* polish: the ``core`` cohorts of each start that are least decided at its prices are chosen anew together, by a beam over their actions
  under the room that all others leave (exact where the beam holds every label that can still win).

A round of either is one job for all starts; per start only sums and the few cohorts of the core come to the driver.  If no portfolio within the budgets is found, a grid of
directions is tried: the problem is Infeasible if in some direction even the leanest choice is above the budgets, else Undecided.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import money_sum
from .decide import coefficients
from .staging import staged

RESOURCES = ("capital", "cession", "nonrenew")
_BINS = 64  # bins to each factor of e


@dataclass
class Found:
    """The best portfolio of a problem; ``bound`` is what no portfolio within the budgets can exceed."""

    status: str
    objective: float | None
    bound: float
    prices: tuple[float, float, float]

    @property
    def gap(self) -> float | None:
        return None if self.objective is None else (self.bound - self.objective) / max(1.0, abs(self.bound))


def _options(cohorts: DataFrame) -> DataFrame:
    """One row per cohort with its actions in order."""
    each = coefficients(cohorts).select("cohort_id", F.struct("action_idx", "action", "profit", *RESOURCES).alias("a"))
    return each.groupBy("cohort_id").agg(F.array_sort(F.collect_list("a")).alias("acts"))


def _per(options: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """Each cohort with each of the driver's ``rows``, as column p."""
    return options.withColumn("p", F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _score(a: Column, p: Column) -> Column:
    return a["profit"] - p["capital"] * a["capital"] - p["cession"] * a["cession"] - p["nonrenew"] * a["nonrenew"]


def _pick(p: Column) -> Column:
    """The action with the highest profit less priced resources, the first in order at ties."""
    best = F.array_max(F.transform("acts", lambda a: F.struct(F.round(_score(a, p), 6).alias("s"), (-a["action_idx"]).alias("i"))))
    return F.get("acts", -best["i"])


def _priced(options: DataFrame, trials: list[tuple[float, float, float]]) -> list[tuple[float, ...]]:
    """(profit, capital, cession, nonrenew) of the choice at each trial's prices: one job."""
    rows = _per(options, [{"t": t, **dict(zip(RESOURCES, x))} for t, x in enumerate(trials)], "t int, capital double, cession double, nonrenew double")
    sums = rows.select(F.col("p")["t"].alias("t"), _pick(F.col("p")).alias("x")).groupBy("t").agg(*(money_sum(F.col("x")[c]).alias(c) for c in ("profit", *RESOURCES))).collect()
    found = {r["t"]: tuple(r[c] or 0.0 for c in ("profit", *RESOURCES)) for r in sums}
    return [found.get(t, (0.0,) * 4) for t in range(len(trials))]


def _within(used, budgets) -> bool:
    return all(u <= b + 1e-9 * max(1.0, abs(b)) for u, b in zip(used, budgets))


def _moved(used, change) -> tuple[float, ...]:
    return tuple(u + change[c] for u, c in zip(used, ("profit", *RESOURCES)))


def _bin(ratio: Column) -> Column:
    return F.when(ratio.isNotNull(), F.floor(F.log(F.greatest(ratio, F.lit(1e-12))) * _BINS).cast("long"))


class _Starts:
    """Choices under way: column x (an action of acts) per start and cohort, changed by rules that the driver learns round by round."""

    def __init__(self, options: DataFrame, starts: list[dict]):
        self.rows = _per(options, starts, "s int, capital double, cession double, nonrenew double").withColumn("x", _pick(F.col("p"))).withColumn("s", F.col("p")["s"]).drop("p")

    def settle(self) -> None:
        """Write the choices down, so that later rounds don't start from the first one."""
        self.rows = staged(self.rows, "choices")

    def sums(self) -> dict[int, tuple[float, ...]]:
        out = self.rows.groupBy("s").agg(*(money_sum(F.col("x")[c]).alias(c) for c in ("profit", *RESOURCES))).collect()
        return {r["s"]: tuple(r[c] or 0.0 for c in ("profit", *RESOURCES)) for r in out}

    def moves(self, rules: list[dict], schema: str, better) -> DataFrame:
        """Rows with their start's rule and the best move m (ratio, i) that ``better`` (a, x, rule to ratio or null) allows; the least ratio wins."""
        rule = F.element_at(F.from_json(F.lit(json.dumps({str(r["s"]): r for r in rules})), f"map<string, struct<{schema}>>"), F.col("s").cast("string"))
        rows = self.rows.withColumn("rule", rule)
        listed = F.filter(F.transform("acts", lambda a: F.struct(better(a, F.col("x"), F.col("rule")).alias("ratio"), a["action_idx"].alias("i"))), lambda m: m["ratio"].isNotNull())
        return rows.withColumn("m", F.array_min(listed)).withColumn("to", F.get("acts", F.col("m")["i"])).withColumn("bin", _bin(F.col("m")["ratio"]))

    def groups(self, moves: DataFrame) -> dict[int, list]:
        """Per start: bins by rising ratio with the sums that their moves change, and each bin's first cohort with its own change."""
        delta = {c: F.col("to")[c] - F.col("x")[c] for c in ("profit", *RESOURCES)}
        first = F.min_by(F.struct("cohort_id", *(d.alias(c) for c, d in delta.items())), F.struct(F.col("m")["ratio"], F.col("cohort_id"))).alias("first")
        out: dict[int, list] = {}
        # cohorts without a move have no bin and are left out here: a filter on them would be pushed below, and repeat, the rules of all rounds before
        for r in moves.groupBy("s", "bin").agg(first, *(money_sum(d).alias(c) for c, d in delta.items())).collect():
            if r["bin"] is not None:
                out.setdefault(r["s"], []).append(r)
        return {s: sorted(bins, key=lambda r: r["bin"]) for s, bins in out.items()}

    def core(self, prices: list[dict], size: int) -> dict[int, list]:
        """Per start the ``size`` cohorts whose two best actions at its prices are closest."""
        p = F.element_at(F.from_json(F.lit(json.dumps({str(r["s"]): r for r in prices})), "map<string, struct<capital double, cession double, nonrenew double>>"), F.col("s").cast("string"))
        ordered = F.sort_array(F.transform("acts", lambda a: F.round(_score(a, F.col("p")), 6)), asc=False)
        margins = self.rows.withColumn("p", p).withColumn("scores", ordered).select("s", "cohort_id", "acts", F.col("x")["action_idx"].alias("at"), (F.get("scores", F.lit(0)) - F.get("scores", F.lit(1))).alias("margin"))
        nth = F.row_number().over(Window.partitionBy("s").orderBy("margin", "cohort_id"))
        out: dict[int, list] = {}
        for r in margins.withColumn("n", nth).where(F.col("n") <= size).collect():
            out.setdefault(r["s"], []).append(r)
        return out

    def put(self, chosen: dict[str, int]) -> None:
        """Actions by number for single cohorts, keyed by start|cohort."""
        to = F.element_at(F.from_json(F.lit(json.dumps(chosen)), "map<string, int>"), F.concat_ws("|", F.col("s").cast("string"), F.col("cohort_id").cast("string")))
        self.rows = self.rows.withColumn("x", F.coalesce(F.get("acts", to), "x"))

    def take(self, moves: DataFrame, limits: dict[int, int], single: dict[int, str]) -> None:
        """Carry out moves in bins up to each start's limit, or of its one cohort."""
        upto = F.element_at(F.from_json(F.lit(json.dumps({str(s): b for s, b in limits.items()})), "map<string, long>"), F.col("s").cast("string"))
        one = F.element_at(F.from_json(F.lit(json.dumps({str(s): c for s, c in single.items()})), "map<string, string>"), F.col("s").cast("string"))
        taken = F.col("m").isNotNull() & (F.coalesce(F.col("bin") <= upto, F.lit(False)) | F.coalesce(F.col("cohort_id").cast("string") == one, F.lit(False)))
        self.rows = moves.select("cohort_id", "acts", "s", F.when(taken, F.col("to")).otherwise(F.col("x")).alias("x"))


def _beam(core: list, used, budgets, prices, width: int = 4000) -> tuple[list[int], np.ndarray] | None:
    """The best actions (numbers) of the core's cohorts and the sums after them; None if no label fits the budgets."""
    options = [np.array([[a[c] or 0.0 for c in ("profit", *RESOURCES)] for a in r["acts"]]) for r in core]
    base = np.array(used) - sum(o[r["at"]] for o, r in zip(options, core))
    room = np.array([b + 1e-9 * max(1.0, abs(b)) for b in budgets])
    least = np.cumsum([o[:, 1:].min(axis=0) for o in options][::-1], axis=0)[::-1]
    labels, codes = base[None, :], np.zeros((1, 0), np.int64)
    for k, o in enumerate(options):
        labels = (labels[:, None, :] + o[None, :, :]).reshape(-1, 4)
        codes = np.hstack((np.repeat(codes, len(o), axis=0), np.tile(np.arange(len(o)), len(codes))[:, None]))
        ahead = least[k + 1] if k + 1 < len(options) else np.zeros(3)
        fits = (labels[:, 1:] + ahead <= room).all(axis=1)
        labels, codes = labels[fits], codes[fits]
        if not len(labels):
            return None
        order = np.argsort(-(labels[:, 0] - labels[:, 1:] @ prices), kind="stable")[:width]
        labels, codes = labels[order], codes[order]
    best = int(np.argmax(labels[:, 0]))
    return codes[best].tolist(), labels[best]


def _relieves(a: Column, x: Column, rule: Column) -> Column:
    """What a unit of relief of the exceeded budget costs, other budgets at their prices."""
    relief = sum((F.when(rule["over"] == c, x[c] - a[c]).otherwise(0.0) for c in RESOURCES), F.lit(0.0))
    cost = sum((F.when(rule["over"] == c, 0.0).otherwise(rule[c] * (a[c] - x[c])) for c in RESOURCES), x["profit"] - a["profit"])
    return F.when(relief > 1e-9, F.greatest(cost, F.lit(0.0)) / relief)


def _gains(a: Column, x: Column, rule: Column) -> Column:
    """Room that a unit of profit takes, if the move fits; resources are in shares of the room that is left."""
    gain = a["profit"] - x["profit"]
    fits = F.lit(True)
    for c in RESOURCES:
        fits = fits & (a[c] - x[c] <= rule[c])
    room = sum((F.greatest(a[c] - x[c], F.lit(0.0)) / F.greatest(rule[c], F.lit(1e-6)) for c in RESOURCES), F.lit(0.0))
    return F.when(fits & (gain > 1e-6), (room + 1e-9) / gain)


def search(cohorts: DataFrame, problems: dict[str, tuple[float, float, float]], *, starts: int = 6, repairs: int = 6, improvements: int = 4, core: int = 14, tolerance: float = 1e-3) -> tuple[dict[str, Found], DataFrame]:
    """Portfolios for all ``problems`` (name to budgets of capital, cession and non-renewed value).

    Returns what was found by name, and (problem, cohort_id, action) of the portfolios found.  status: Optimal (within ``tolerance`` of the dual bound),
    Feasible (its gap is stated), Infeasible (proven by a direction) or Undecided.
    """
    # the work is cohorts times trials, so cohorts are dealt to all cores, however few rows they are
    options = staged(_options(cohorts).repartition(cohorts.sparkSession.sparkContext.defaultParallelism, "cohort_id"), "options")
    names = list(problems)
    unit = options.select(F.explode("acts").alias("a")).agg(F.sum(F.abs("a.profit")), *(F.sum(F.abs(f"a.{c}")) for c in RESOURCES)).first()
    scale = [(unit[0] or 1.0) / max(unit[k + 1] or 0.0, 1e-9) for k in range(3)]
    known: dict[tuple[float, float, float], tuple[float, ...]] = {}

    def value(trials) -> None:
        new = [t for t in dict.fromkeys(trials) if t not in known]
        known.update(zip(new, _priced(options, new)) if new else ())

    dual = lambda t, b: known[t][0] - sum(p * (u - c) for p, u, c in zip(t, known[t][1:], b))
    value(itertools.product(*([0.0, *(m * s for m in (0.05, 0.3, 1.5, 8.0))] for s in scale)))
    for f in (3.0, 2.0, 1.4, 1.2, 1.1):
        trials = []
        for b in problems.values():
            at = min(known, key=lambda t: dual(t, b))
            trials += itertools.product(*((x / f, x, x * f) if x else (0.0, s * 0.01 * (f - 1)) for x, s in zip(at, scale)))
        value(trials)
    bound = {n: min(dual(t, b) for t in known) for n, b in problems.items()}
    ordered = {n: sorted(known, key=lambda t: dual(t, b)) for n, b in problems.items()}
    begun, of = [], {}
    for n in names:
        fitting = [t for t in ordered[n] if _within(known[t][1:], problems[n])]
        chosen = list(dict.fromkeys([*ordered[n][: starts - 2], *sorted(fitting, key=lambda t: -known[t][0])[:2]]))
        for t in chosen:
            of[len(begun)] = n
            begun.append({"s": len(begun), **dict(zip(RESOURCES, t))})
    prices = {r["s"]: [max(r[c], 0.02 * s) for c, s in zip(RESOURCES, scale)] for r in begun}
    under = _Starts(options, begun)
    now = under.sums()
    for n in range(repairs):
        rules = []
        for s, used in now.items():
            b = problems[of[s]]
            over = [(u - c) / max(abs(c), 1e-6 * unit[k + 1], 1e-9) for k, (u, c) in enumerate(zip(used[1:], b))]
            if not _within(used[1:], b):
                k = over.index(max(over))
                prices[s][k] *= 2.0
                rules.append({"s": s, "over": RESOURCES[k], **dict(zip(RESOURCES, prices[s]))})
        if not rules:
            break
        moves = under.moves(rules, "over string, capital double, cession double, nonrenew double", _relieves)
        limits: dict[int, int] = {}
        for s, bins in under.groups(moves).items():
            rule = next(r for r in rules if r["s"] == s)
            excess, relieved = now[s][1 + RESOURCES.index(rule["over"])] - problems[of[s]][RESOURCES.index(rule["over"])], 0.0
            for r in bins:
                relieved, limits[s] = relieved - r[rule["over"]], r["bin"]
                now[s] = _moved(now[s], r)
                if relieved >= excess:
                    break
        if not limits:
            break
        under.take(moves, limits, {})
        if n % 3 == 2:
            under.settle()
    for _ in range(improvements):
        rules = [{"s": s, **{c: b - u for c, b, u in zip(RESOURCES, problems[of[s]], used[1:])}} for s, used in now.items() if _within(used[1:], problems[of[s]])]
        if not rules:
            break
        moves = under.moves(rules, "capital double, cession double, nonrenew double", _gains)
        limits, single = {}, {}
        for s, bins in under.groups(moves).items():
            room, left = next(r for r in rules if r["s"] == s), [0.0] * 3
            for r in bins:
                left = [x + r[c] for x, c in zip(left, RESOURCES)]
                if any(x > room[c] for x, c in zip(left, RESOURCES)):
                    break
                limits[s] = r["bin"]
                now[s] = _moved(now[s], r)
            if s not in limits:
                single[s] = str(bins[0]["first"]["cohort_id"])
                now[s] = _moved(now[s], bins[0]["first"])
        if not limits and not single:
            break
        under.take(moves, limits, single)
    now = under.sums()
    under.settle()
    asked = [{"s": s, **dict(zip(RESOURCES, ordered[of[s]][0]))} for s in now]
    chosen = {}
    for s, own in under.core(asked, core).items():
        found = _beam(own, now[s], problems[of[s]], np.array(ordered[of[s]][0]))
        if found and (not _within(now[s][1:], problems[of[s]]) or found[1][0] > now[s][0]):
            chosen |= {f"{s}|{r['cohort_id']}": i for r, i in zip(own, found[0])}
            now[s] = tuple(found[1].tolist())
    under.put(chosen)
    out, kept = {}, {}
    for n, b in problems.items():
        fitting = [(now[s][0], -s) for s in now if of[s] == n and _within(now[s][1:], b)]
        if fitting:
            profit, s = max(fitting)
            kept[-s] = n
            out[n] = Found("Optimal" if bound[n] - profit <= tolerance * max(1.0, abs(bound[n])) else "Feasible", profit, bound[n], tuple(begun[-s][c] for c in RESOURCES))
    lost = [n for n in names if n not in out]
    if lost:
        leaner = _leanest(options, unit)
        for n in lost:
            proven = any(sum(w * (u - b) for w, u, b in zip(d, used, problems[n])) > 1e-9 for d, used in leaner)
            out[n] = Found("Infeasible" if proven else "Undecided", None, bound[n], ordered[n][0])
    named = F.element_at(F.from_json(F.lit(json.dumps({str(s): n for s, n in kept.items()})), "map<string, string>"), F.col("s").cast("string"))
    portfolio = under.rows.select(named.alias("problem"), "cohort_id", F.col("x")["action"].alias("action")).where("problem IS NOT NULL")
    return {n: out[n] for n in names}, portfolio


def _leanest(options: DataFrame, unit, steps: int = 12) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    """(direction, resources used by the choice that is leanest in it): a grid over the simplex, in one job."""
    directions = [(i, j, steps - i - j) for i in range(steps + 1) for j in range(steps + 1 - i)]
    weights = [tuple(x / steps / max(unit[k + 1] or 0.0, 1e-9) for k, x in enumerate(d)) for d in directions]
    rows = _per(options, [{"t": t, **dict(zip(RESOURCES, w))} for t, w in enumerate(weights)], "t int, capital double, cession double, nonrenew double")
    p = F.col("p")
    lean = F.array_min(F.transform("acts", lambda a: F.struct(sum((p[c] * a[c] for c in RESOURCES), F.lit(0.0)).alias("w"), a["action_idx"].alias("i"))))
    x = F.get("acts", lean["i"])
    sums = rows.select(p["t"].alias("t"), x.alias("x")).groupBy("t").agg(*(money_sum(F.col("x")[c]).alias(c) for c in RESOURCES)).collect()
    return [(weights[r["t"]], tuple(r[c] or 0.0 for c in RESOURCES)) for r in sums]


def search_one(cohorts: DataFrame, *, capital: float, nonrenew_share: float, cession: float, **how) -> tuple[Found, DataFrame]:
    """``search`` for one set of budgets; the second budget is a share of all insured value.  (cohort_id, action) is empty if nothing was found."""
    tiv = cohorts.agg(money_sum("total_tiv")).first()[0] or 0.0
    found, portfolio = search(cohorts, {"only": (capital, cession, nonrenew_share * tiv)}, **how)
    return found["only"], portfolio.drop("problem")


def replications(cohorts: DataFrame, *, draws: int, times: int, capital_share: float, nonrenew_share: float, cession_share: float) -> DataFrame:
    """(replication, status, x): objectives of ``times`` samples of ``draws`` losses per cohort, whose tails take the place of the cohorts' own.

    Budgets of capital and cession are shares of a sample's summed p99.
    """
    from .loss import prior_losses, tails

    if times < 2:
        raise ValueError("a spread needs at least two replications")
    rows = []
    for r in range(times):
        own = tails(prior_losses(cohorts, draws, stream=10 + r)).select("cohort_id", F.col("p50").alias("loss_p50"), F.col("tvar").alias("loss_p99"))
        sample = staged(cohorts.drop("loss_p50", "loss_p99").join(own, "cohort_id"), "sample")
        p99 = sample.agg(money_sum("loss_p99")).first()[0] or 0.0
        found, _ = search_one(sample, capital=capital_share * p99, nonrenew_share=nonrenew_share, cession=cession_share * p99)
        rows.append((r, found.status, found.objective))
    return cohorts.sparkSession.createDataFrame(rows, "replication int, status string, x double")
