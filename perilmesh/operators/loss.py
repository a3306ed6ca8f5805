"""Loss tables in long form (cohort_id, k, loss): scenario draws, footprints, tails and treaties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import _c, case_of, damage_ratio, in_ring, money_sum, normal, peril_decay, ring_distance


def cohort_number(zip3="zip3", build="build_type", q="tiv_quintile") -> Column:
    """A number per cohort that both engines can make."""
    b = F.when(_c(build) == "wood_frame", 0).when(_c(build) == "masonry", 1).otherwise(2)
    return (_c(zip3).cast("long") * 10 + b) * 10 + _c(q)


def _dealt(cohorts: DataFrame) -> DataFrame:
    """Cohorts dealt to all cores before they are multiplied by draws: few rows would else stay in one task.  Sums per cohort need no further shuffle."""
    return cohorts.repartition(cohorts.sparkSession.sparkContext.defaultParallelism, "cohort_id")


def prior_losses(cohorts: DataFrame, draws: int, *, sigma: float = X.PRIOR_SIGMA, stream: int = 0) -> DataFrame:
    """Lognormal losses: one row per cohort and draw k, around the cohort's median loss."""
    rows = _dealt(cohorts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    z = normal((cohort_number() * 10 + stream) * 1000 + F.col("k"))
    return rows.select("cohort_id", "k", F.round(F.col("loss_p50") * F.exp(sigma * z), 2).alias("loss"))


def peril_overlay(cohorts: DataFrame, draws: int) -> DataFrame:
    """Losses of further perils, independent by peril, with mean rate * value * vulnerability."""
    perils = cohorts.sparkSession.createDataFrame([(i, p) for i, p in enumerate(X.AAL_RATE)], "stream int, peril string")
    rows = _dealt(cohorts).join(F.broadcast(perils)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    rate = vulnerability = sigma = F.lit(None).cast("double")
    for p in X.AAL_RATE:
        rate = F.when(F.col("peril") == p, case_of("state", {k: v for k, v in X.AAL_RATE[p].items() if k != "default"}, X.AAL_RATE[p]["default"])).otherwise(rate)
        vulnerability = F.when(F.col("peril") == p, case_of("build_type", X.AAL_VULNERABILITY[p], 1.0)).otherwise(vulnerability)
        sigma = F.when(F.col("peril") == p, F.lit(X.AAL_SIGMA[p])).otherwise(sigma)
    rows = rows.select("cohort_id", "peril", "k", (F.col("total_tiv") * rate * vulnerability).alias("aal"), sigma.alias("s"), normal((cohort_number() * 10 + F.col("stream") + 1) * 1000 + F.col("k")).alias("z"))
    return rows.select("cohort_id", "peril", "k", F.round(F.exp(F.log("aal") - F.col("s") * F.col("s") / 2 + F.col("s") * F.col("z")), 2).alias("loss"))


def common_factor(losses: DataFrame, beta: float, *, floor: bool = False) -> DataFrame:
    """Losses times 1 + beta * e, with one e per draw for all cohorts; at least 0 if ``floor``."""
    factor = 1 + beta * normal(F.col("k") + 77)
    factor = F.greatest(F.lit(0.0), factor) if floor else factor
    return losses.withColumn("loss", F.round(F.col("loss") * factor, 2))


def _at(values: str, share: float) -> Column:
    """The linearly interpolated quantile of a sorted array."""
    place = share * (F.size(values) - 1)
    low = F.floor(place)
    at = lambda i: F.element_at(values, i.cast("int"))
    return at(low + 1) + (place - low) * (at(F.ceil(place) + 1) - at(low + 1))


def tails(losses: DataFrame, *, share: float = 0.99) -> DataFrame:
    """p50, p99 (linear) and TVaR, the mean of the draws at or above p99, per cohort.

    A cohort's draws are bounded by the number of scenarios, so one pass lists them sorted; nothing is joined back.
    """
    listed = losses.where("loss IS NOT NULL").groupBy("cohort_id").agg(F.array_sort(F.collect_list("loss")).alias("v"))
    p99 = listed.withColumn("p50", _at("v", 0.5)).withColumn("p99", _at("v", share))
    tail = p99.withColumn("v", F.filter("v", lambda x: x >= F.col("p99")))
    total = F.aggregate("v", F.lit(0).cast("decimal(38,4)"), lambda acc, x: (acc + x.cast("decimal(18,4)")).cast("decimal(38,4)"))
    return tail.select("cohort_id", "p50", "p99", (total.cast("double") / F.size("v")).alias("tvar"))


def book_losses(losses: DataFrame) -> DataFrame:
    """(cohort_id 'book', k, loss): the book's loss in each draw, over all cohorts; a missing (cohort, draw) counts as 0."""
    return losses.groupBy("k").agg(money_sum("loss").alias("loss")).select(F.lit("book").alias("cohort_id"), "k", "loss")


def top_mean(book: DataFrame, draws: int, *, share: float = 0.01) -> DataFrame:
    """Rockafellar-Uryasev tail mean of a fixed mix: the mean of the ``share`` of draws with the largest losses.

    A top-k over the draws of one book.
    """
    m = max(1, round(draws * share))
    return book.orderBy(F.desc("loss"), "k").limit(m).agg((money_sum("loss") / m).alias("tvar"))


def merged(prior: DataFrame, sim: DataFrame, offset: int) -> DataFrame:
    """Prior draws and simulated ones behind them, in long form; sim cohorts that the prior lacks are left out."""
    known = prior.select("cohort_id").distinct()
    return prior.unionByName(sim.join(known, "cohort_id", "left_semi").withColumn("k", F.col("k") + offset))


def footprint_losses(policies: DataFrame, rings: DataFrame, peril: str, multiplier: float, *, width_km: float = 0.0, cell: float = 0.1, most_cells: int = 500_000) -> DataFrame:
    """(cohort_id, k, loss) of policies inside the ring of each draw (k, ring: closed array of (x, y), factor).

    Both sides are keyed by the cells of a grid and joined by equality.  No edge crosses most cells of a ring: they
    lie inside as a whole, and their sums per cohort are joined instead of policies.  Only in cells near an edge is each policy
    tested against the ring.  A tornado or hail core of ``width_km`` makes losses fall with the distance to the ring (a degree
    is 111 km), so then each policy is tested.  The rings' cells, counted first, are broadcast up to ``most_cells``; beyond that
    both sides are shuffled by cell, and crowded cells are split at run time.  Policies outside all rings' boxes are filtered in the scan.
    """
    x, y = lambda i: F.col("ring")[i]["x"], lambda i: F.col("ring")[i]["y"]
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    number = lambda v: F.floor(v / F.lit(cell))
    span = lambda v: F.sequence(number(F.array_min(v)), number(F.array_max(v)))
    size = lambda v: number(F.array_max(v)) - number(F.array_min(v)) + 1
    found = rings.agg(F.max(F.size("ring")), F.sum(size(xs) * size(ys)), *(f(g(v)) for v in (xs, ys) for f, g in ((F.min, F.array_min), (F.max, F.array_max)))).first()  # rings are one a draw
    points, count, *box = found
    points = points or 0
    inside = lambda x, y: in_ring(x, y, "ring", points if points <= 32 else None)
    cells = rings.where(F.size("ring") >= 4).withColumn("i", F.explode(span(xs))).withColumn("j", F.explode(span(ys)))
    left, low = F.col("i") * cell - 1e-9, F.col("j") * cell - 1e-9
    right, high = left + cell + 2e-9, low + cell + 2e-9

    def touches(n):  # the box around an edge meets the cell
        a, b, c, d = x(n - 1), x(n), y(n - 1), y(n)
        return (F.least(a, b) <= right) & (F.greatest(a, b) >= left) & (F.least(c, d) <= high) & (F.greatest(c, d) >= low)

    near = F.exists(F.sequence(F.lit(1), F.size("ring") - 1), touches) if not width_km else F.lit(True)
    cells = cells.withColumn("near", near).where(F.col("near") | inside((left + right) / 2, (low + high) / 2))
    sides = lambda which, *names: cells.where(which).select(*names).hint("broadcast" if (count or 0) <= most_cells else "merge")
    value = F.col("tiv") * damage_ratio(F.lit(peril), "build_type", F.lit(multiplier))
    held = F.col("lon").between(*box[:2]) & F.col("lat").between(*box[2:])
    placed = policies.where(held).select("cohort_id", "lon", "lat", number(F.col("lon")).alias("i"), number(F.col("lat")).alias("j"), value.alias("value"))
    sums = placed.groupBy("i", "j", "cohort_id").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))
    whole = sums.join(sides("NOT near", "i", "j", "k", "factor"), ["i", "j"]).select("cohort_id", "k", "factor", "value")
    met = placed.join(sides("near", "i", "j", "k", "factor", "ring"), ["i", "j"]).where(inside("lon", "lat"))
    if width_km:
        met = met.withColumn("value", F.col("value") * peril_decay(F.lit(peril), ring_distance("lon", "lat", "ring") * 111.0, F.lit(float(width_km))))
    tested = met.groupBy("cohort_id", "k", "factor").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))
    both = tested if width_km else whole.unionByName(tested.withColumn("value", F.col("value").cast("decimal(28,4)")))
    return both.groupBy("cohort_id", "k", "factor").agg(F.sum("value").cast("double").alias("value")).select("cohort_id", "k", F.round(F.col("value") * F.col("factor"), 2).alias("loss"))


def layer_capacity(losses: DataFrame, attachment: float, exhaustion: float, reinstatements: int) -> DataFrame:
    """Losses of an ordered event stream (event_id, loss) through a layer of limited capacity.

    The sequential rule has a closed form: with cum the running sum of uncapped ceded
    losses and C the capacity, event i cedes min(C, cum_i) - min(C, cum_(i-1)).
    """
    ceded = F.greatest(F.lit(0.0), F.least(F.col("loss"), F.lit(exhaustion)) - attachment)
    total = (exhaustion - attachment) * (1 + reinstatements)
    w = Window.partitionBy("layer").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(ceded.cast("decimal(18,4)")).over(w).cast("double")
    rows = losses.withColumn("uncapped", ceded).withColumn("cum", cum)
    before = F.col("cum") - F.col("uncapped")
    return rows.select("layer", "event_id", "loss", F.round(F.least(F.lit(total), F.col("cum")) - F.least(F.lit(total), before), 2).alias("ceded"))
