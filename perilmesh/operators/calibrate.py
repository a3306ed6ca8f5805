"""Calibration and evaluation: episode spread, reliability, histograms, forecast errors, regimes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import _c, money_sum


def episode_beta(events: DataFrame, *keys: str, least: int = 8) -> DataFrame:
    """Coefficient of variation of episode totals: (n, beta, status); totals of 0 don't count, fewer than ``least`` are too few."""
    totals = events.where("damage_property IS NOT NULL").groupBy(*keys).agg(money_sum("damage_property").alias("total")).where("total > 0")
    out = totals.agg(F.count("*").alias("n"), F.stddev_samp("total").alias("sd"), F.avg("total").alias("mean"))
    return out.select("n", F.when(F.col("n") >= least, F.col("sd") / F.col("mean")).alias("beta"), F.when(F.col("n") >= least, "FITTED").otherwise("INSUFFICIENT").alias("status"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, mean_forecast, observed, n) of (forecast, observation) in equal-width bins of the forecast.

    As in the source system the row with the largest forecast falls off the last bin.  The share of the span is taken
    first and then multiplied (``width_bucket`` does it the other way round, which moves forecasts that lie on an edge).
    Without a finite span no row has a bin.
    """
    span = rows.agg(F.min("forecast").alias("lo"), F.max("forecast").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when((width > 0) & (width < float("inf")), F.floor((F.col("forecast") - F.col("lo")) / width * bins))
    binned = rows.join(F.broadcast(span)).withColumn("bin", place).where(f"bin < {bins}")
    return binned.groupBy("bin").agg((money_sum("forecast") / F.count("*")).alias("mean_forecast"), F.avg((F.col("observation") <= F.col("forecast")).cast("double")).alias("observed"), F.count("*").alias("n"))


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """Counts of ``x`` in [0, 1] in equal bins, the last one closed; empty bins count 0."""
    dim = values.sparkSession.range(bins).select(F.col("id").alias("bin"))
    own = values.where("x BETWEEN 0 AND 1").groupBy(F.least(F.floor(F.col("x") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return dim.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distance_histogram(values: DataFrame, width: float, bins: int) -> DataFrame:
    """Counts of distances ``x`` in bins of ``width``; what lies beyond goes into the last."""
    return histogram(values.select(F.least(_c("x") / (width * bins), F.lit(1.0)).alias("x")), bins)


def pinball(y, prediction, q: float) -> Column:
    """Mean pinball loss at quantile q."""
    d = _c(y) - _c(prediction)
    return F.avg(F.greatest(q * d, (q - 1) * d))


def error_stats(errors: DataFrame, since: int) -> DataFrame:
    """Per lead hour, over all years and over those from ``since``: sd, mean and 67th percentile of the size, n; null below 2."""
    windows = F.explode(F.when(F.col("year") >= since, F.array(F.lit("full"), F.lit("recent"))).otherwise(F.array(F.lit("full"))))
    out = errors.withColumn("window", windows).groupBy("hour", "window").agg(F.count("*").alias("n"), F.stddev_samp("error").alias("sd"), F.avg(F.abs("error")).alias("mae"), F.percentile(F.abs("error"), 0.67).alias("p67"))
    return out.select("hour", "window", "n", *(F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in ("sd", "mae", "p67")))


def latest_at(values: DataFrame, dates: DataFrame, block: int = 120) -> DataFrame:
    """For each (year, month) of ``dates`` the value of that month or of the latest one before it; null if there is none.

    An as-of join without pairs: values and dates are united, reduced to a row per month and filled forward within blocks of ``block``
    months; what a block starts with is the last value of the blocks before it (one row per block).  Null values don't count; of
    several values of a month the largest does.
    """
    at = (F.col("year").cast("long") * 12 + F.col("month") - 1).alias("at")
    v = values.where("value IS NOT NULL").select(at, "value", F.lit(None).cast("struct<year:bigint,month:bigint>").alias("asked"))
    d = dates.select(at, F.lit(None).cast(values.schema["value"].dataType).alias("value"), F.struct(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).alias("asked"))
    months = v.unionByName(d).groupBy("at").agg(F.max("value").alias("value"), F.max("asked").alias("asked")).withColumn("block", F.floor(F.col("at") / block))
    within = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = months.groupBy("block").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("end"))
    carried = ends.select("block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    filled = months.withColumn("own", F.last("value", ignorenulls=True).over(within)).where("asked IS NOT NULL")
    types = {f.name: f.dataType for f in dates.schema.fields}
    return filled.join(carried, "block").select(*(F.col(f"asked.{c}").cast(types[c]).alias(c) for c in ("year", "month")), F.coalesce("own", "carried").alias("value"))


def regime(amo, oni) -> tuple[Column, Column]:
    return F.when(_c(amo) >= 0, "warm").otherwise("cool"), F.when(_c(oni) >= 0.5, "nino").when(_c(oni) <= -0.5, "nina").otherwise("neutral")


def bucket_frequencies(mph: DataFrame) -> DataFrame:
    """Shares of storm classes of ``mph``; every class is listed, too weak winds don't count."""
    from ..functions.scalars import storm_bucket

    dim = mph.sparkSession.createDataFrame([(i, b) for i, (_, b) in enumerate(X.STORM_BUCKETS)], "ord int, bucket string")
    own = mph.groupBy(storm_bucket("mph").alias("bucket")).agg(F.count("*").alias("n")).where("bucket IS NOT NULL")
    total = own.agg(F.sum("n").alias("total"))
    return dim.join(own, "bucket", "left").join(F.broadcast(total)).select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 9).alias("share"))


def log_likelihood(counts: DataFrame) -> DataFrame:
    """Sum of n * ln(p) over (n, p); minus infinity if an observed class has no probability."""
    term = F.when(F.col("n") == 0, 0.0).when(F.col("p") <= 0, F.lit(float("-inf"))).otherwise(F.col("n") * F.log("p"))
    return counts.agg(F.sum(term).alias("ll"))


def envelope(values: DataFrame) -> DataFrame:
    """Mean, spread, half width of the 95 % interval and gap to the best of replications (x)."""
    return values.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), (1.96 * F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("half"), (F.max("x") - F.avg("x")).alias("gap"))
