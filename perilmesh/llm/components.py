"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def _marks(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) pairs: v's of u are hung onto the least id of u's group."""
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m")), "least").withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return staged(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")


def _both_stars(edges: DataFrame) -> DataFrame:
    """A large and a small star step over few ``edges``, in one task: one partition needs no exchange, no join and no stage between."""
    turned = lambda a, b: F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(b.alias("u"), a.alias("v"))))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    hung = lambda pairs: pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    both = edges.coalesce(1).select(turned(u, v).alias("e")).select("e.u", "e.v").withColumn("m", least)
    large = hung(both.where("v > u").select(v.alias("u"), m.alias("v"))).withColumn("m", least)
    small = large.select(F.explode(F.array(F.struct(v.alias("u"), m.alias("v")), F.struct(u.alias("u"), m.alias("v")))).alias("e")).select("e.u", "e.v")
    return staged(hung(small), "stars")


def components(links: DataFrame, *, most_rounds: int = 40, few: int = 200_000) -> DataFrame:
    """Members of all components of ``links`` (a, b: long ids).

    Returns (member, component) for each id that is linked to another one;
    component is the smallest id of its component, which is itself a member of
    no row.  Rows with a null or with a = b link nothing.  Each step is a join and
    an aggregation, staged in the shared folder so that lost executors cost one step
    at most.  Links are counted before each round: up to ``few`` go through it in one task (their number
    bounds it), as dealing them to all partitions would take many times the work; more are shuffled.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _marks(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        if before[0] <= few:
            edges = _both_stars(edges)
        else:
            both = staged(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
            edges = _star(_star(both, large=True), large=False)
        after = _marks(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("member"), F.col("v").alias("component"))
