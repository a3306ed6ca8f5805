"""Exact quantile cuts, cohort ids and cohort aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import _c, loss_p50, money_sum


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], *, most_values: int = 20_000) -> list[float]:
    """Linearly interpolated quantiles of all non-null values, without sorting or gathering them.

    The order statistics that are needed are narrowed down by counting passes, each over all open
    brackets at once with 1024 bins a bracket.  Values are listed only where a bracket holds at most
    ``most_values`` of them.  Ten thousand million values take two counting passes and one that lists.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return []
    wanted = sorted({k for s in shares for k in (int(s * (n - 1)), min(n - 1, int(s * (n - 1)) + 1))})
    found: dict[int, float] = {}
    few: list[tuple] = []
    wide = [(low, high, 0, n, wanted)]  # lowest and highest value, rank of the first, rows, ranks sought there
    while wide:
        todo = []
        for low, high, first, rows, ranks in wide:
            if low == high:
                found.update(dict.fromkeys(ranks, low))
            else:
                (few if rows <= most_values or not (high - low) / 1024 else todo).append((low, high, first, rows, ranks))
        wide = []
        if not todo:
            break
        own = bin_ = F.lit(None).cast("long")
        for g, (low, high, *_) in enumerate(todo):
            here = F.col("x").between(low, high)
            own = F.when(here, F.lit(g)).otherwise(own)
            bin_ = F.when(here, F.least(F.floor((F.col("x") - low) / ((high - low) / 1024)), F.lit(1023))).otherwise(bin_)
        bins = x.select("x", own.alias("g"), bin_.alias("b")).where("g IS NOT NULL").groupBy("g", "b").agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        at = {g: t[2] for g, t in enumerate(todo)}
        for r in sorted(bins, key=lambda r: (r["g"], r["b"])):
            first = at[r["g"]]
            at[r["g"]] = first + r["c"]
            if ranks := [k for k in todo[r["g"]][4] if first <= k < first + r["c"]]:
                wide.append((r["lo"], r["hi"], first, r["c"], ranks))
    if few:
        here = F.lit(False)
        for low, high, *_ in few:
            here = here | F.col("x").between(low, high)
        values = sorted(map(tuple, x.where(here).groupBy("x").count().collect()))
        for low, high, first, _, ranks in few:
            at = first
            for v, c in values:
                if low <= v <= high:
                    found.update({r: v for r in ranks if at <= r < at + c})
                    at += c
    out = []
    for s in shares:
        rank = s * (n - 1)
        k = int(rank)
        out.append(found[k] + (rank - k) * (found[min(n - 1, k + 1)] - found[k]))
    return out


def bin_of(column, cuts: Sequence[float]) -> Column:
    """Number of cuts at or below a value: a value equal to a cut goes up."""
    if not cuts:
        return F.lit(0)
    return sum(((F.lit(c) <= _c(column)).cast("int") for c in cuts[1:]), (F.lit(cuts[0]) <= _c(column)).cast("int"))


def binned(policies: DataFrame) -> DataFrame:
    """Policies with the quintile q of their value in the whole book, and their cohort_id."""
    cuts = exact_quantiles(policies, "tiv", (0.2, 0.4, 0.6, 0.8))
    return policies.withColumn("q", bin_of("tiv", cuts)).withColumn("cohort_id", F.concat("zip3", F.lit("_"), "build_type", F.lit("_q"), F.col("q").cast("string")))


def cohorts(book: DataFrame) -> DataFrame:
    """One row per cohort of ``binned`` policies: counts, sums, modal flood zone, mean elevation, prior median loss."""
    out = book.groupBy("cohort_id").agg(
        F.first("zip3").alias("zip3"), F.first("state").alias("state"), F.first("build_type").alias("build_type"), F.first("q").alias("tiv_quintile"), F.count("*").alias("policy_count"),
        money_sum("tiv").alias("total_tiv"), money_sum(F.coalesce("premium_annual", F.lit(0.0)), 9).alias("total_premium"),
        F.coalesce(F.avg("elevation_m"), F.lit(0.0)).alias("avg_elevation"), F.mode(F.coalesce("flood_zone", F.lit("")), True).alias("modal_zone"),
    )
    return out.withColumn("loss_p50", loss_p50("total_tiv", "modal_zone", "build_type", "avg_elevation"))


def mean_features(book: DataFrame, size: int = 8) -> DataFrame:
    """Element-wise means of the valid JSON feature vectors per cohort; invalid ones don't count."""
    v = F.from_json("cv_features", "array<double>")
    valid = F.when(F.size(v) == size, v)
    return book.withColumn("v", valid).where(F.col("v").isNotNull()).groupBy("cohort_id").agg(
        F.count("*").alias("valid_rows"), *(F.avg(F.coalesce(F.col("v")[i], F.lit(0.0))).alias(f"f{i}") for i in range(size)))
