"""Mixing sources to target weights: whole documents, repeated by rate.

Native DataFrame operations only.  Sizes are summed per source (partial sums
before the shuffle, so a source with a third of all rows is no hot spot), rates
follow from the sums, and each document is taken floor(rate) times plus one copy
if its seeded hash, as a number in [0, 1), is below the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, named, staged

#: More sources than this are joined by salted shuffle instead of broadcast.
MOST_BROADCAST = 50_000


def size_in_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating.  They
    share ``share`` times the total by weight; none gets more than ``most`` times
    its own size, and what exceeds that is shared among the others by weight until
    none is above.  That is the level t with sum(min(cap, weight * t)) = total: with the
    sources in order of cap / weight, the first k are capped for the smallest k at which
    the level of the rest doesn't exceed the next source's cap.  Works on one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    leveled = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    # if none fits, all are at their caps
    return leveled.select("source", "source_size", F.coalesce(F.least("cap", fits * F.col("weight")), "cap").alias("target"))


def _copies(rate: Column, seed: int) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") * F.lit(2.0**-53)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("long")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, size: str | None = None) -> DataFrame:
    """``docs`` with the number of ``copies`` that the mix takes of each row.

    All columns are returned, and size, source_size, target, rate, copies
    (columns of these names are replaced).  ``size`` names a column of docs that has the sizes; by default
    they are the numbers of words of text.  A draw depends on doc_id and the seed
    alone, so reruns agree; rows with equal doc_id (and rows without one) draw alike.
    A null text has size 0; a null source is a source, the last.  A source without
    words has rate 0.  Rates reach the rows by broadcast up to ``MOST_BROADCAST`` sources, else by a salted join.
    """
    own = ("size", "source_size", "target", "rate", "copies")
    amount = size_in_words(F.col("text")) if size is None else named([size])[0]
    (held,) = free_names(docs, "_size")
    docs = docs.withColumn(held, amount).drop(*own)
    totals = staged(docs.groupBy("source").agg(F.sum(held).alias("source_size")), "totals")
    small = totals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rates = source_targets(totals, weights, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    of, salt, row = free_names(docs, "_source", "_salt", "_row")
    rates = staged(rates.select(F.col("source").alias(of), "source_size", "target", "rate"), "rates")
    same = F.col("source").eqNullSafe(F.col(of))
    if small:
        rated = docs.join(F.broadcast(rates), same)
    else:
        salts = 64
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rated = docs.withColumn(row, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, same & (F.col(row) == F.col(salt)))
    kept = [c for c in docs.columns if c != held]
    return rated.select(*named(kept), F.col(held).alias("size"), "source_size", "target", "rate", _copies(F.col("rate"), seed).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken; rows with no copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
