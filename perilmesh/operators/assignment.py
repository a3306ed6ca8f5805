"""Least-cost assignment of many to few places with room, exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: No more places than this: the exchange graph between places is held on the driver.
MOST_PLACES = 2000
_FAR = np.iinfo(np.int64).max // 4


def _negative_cycle(w: np.ndarray) -> list[int] | None:
    """Nodes of a cycle of negative weight, in order, or None if there is none (Bellman and Ford)."""
    n = len(w)
    d, parent, moved = np.zeros(n, np.int64), np.full(n, -1), np.array([], int)
    for _ in range(n):
        through = d[:, None] + w
        best, at = through.min(0), through.argmin(0)
        moved = np.flatnonzero(best < d)
        if not len(moved):
            return None
        d[moved], parent[moved] = best[moved], at[moved]
    v = int(moved[0])
    for _ in range(n):
        v = int(parent[v])
    cycle = [v]
    while (v := int(parent[v])) != cycle[0]:
        cycle.append(v)
    return cycle[::-1]


def _placed_greedily(pairs: DataFrame, room: dict) -> DataFrame:
    """(who, place, cost) with a row for each who, place null where none had room: each round the free ask the cheapest place that has
    room and each place takes the cheapest that ask.  A round fills a place or is the last one, so there are at most as many as places."""
    spark = pairs.sparkSession
    taken = None
    left = dict(room)
    while any(n > 0 for n in left.values()):
        names = spark.createDataFrame([(p, n) for p, n in left.items() if n > 0], pairs.select("place", F.lit(0).alias("left")).schema)
        free = pairs if taken is None else pairs.join(taken.select("who"), "who", "left_anti")
        asked = free.join(F.broadcast(names), "place").groupBy("who").agg(F.min_by(F.struct("place", "cost", "left"), F.struct("cost", "place")).alias("p")).select("who", "p.*")
        ranked = asked.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("cost", "who"))).where("r <= left").select("who", "place", "cost")
        new = staged(ranked, "placed")
        counts = {r["place"]: r["n"] for r in new.groupBy("place").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        taken = new if taken is None else taken.unionByName(new)
        left = {p: n - counts.get(p, 0) for p, n in left.items()}
    everyone = pairs.select("who").distinct()
    if taken is None:
        return everyone.select("who", F.lit(None).cast(pairs.schema["place"].dataType).alias("place"), F.lit(0).cast("long").alias("cost"))
    return everyone.join(taken, "who", "left").select("who", "place", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))


def least_cost(pairs: DataFrame, room: dict, restage: int = 20) -> DataFrame:
    """The (who, place, cost) of ``pairs`` (cost: non-negative long) in which each who has at most one place and each place at most ``room``: as many as can
    be placed, and among those the least total cost.  ``pairs`` lists each (who, place) once.

    Starting from a greedy placement, chains of moves that lower the cost are carried out until there is none, which proves the optimum.
    A round aggregates, for each two places, the cheapest move between them: that table (places squared, never the pairs) is all that
    the driver sees, and it finds the negative cycles in it.  Moves are applied as a small overlay, which is written out every ``restage`` rounds.
    Every round lowers (not placed, cost), so the search ends by itself; it has no limit on rounds.
    """
    spark = pairs.sparkSession
    room = {p: int(n) for p, n in room.items() if n and n > 0}
    if len(room) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places")
    kind = pairs.schema["place"].dataType
    if not room:
        return pairs.limit(0).select("who", "place", "cost")
    names = F.broadcast(spark.createDataFrame([(p,) for p in room], pairs.select("place").schema))
    pairs = staged(pairs.select("who", "place", F.col("cost").cast("long").alias("cost")).join(names, "place").select("who", "place", "cost"), "pairs")
    held = staged(_placed_greedily(pairs, room), "held")
    places = sorted(room)
    at = {p: i for i, p in enumerate(places)}
    out = len(places)  # the node of those without a place, and of free room
    used = {r["place"]: r["n"] for r in held.where("place IS NOT NULL").groupBy("place").agg(F.count("*").alias("n")).collect()}
    most = pairs.agg(F.max("cost")).first()[0] or 0
    penalty = 2 * (out + 2) * (most + 1)
    if penalty * (out + 2) >= _FAR:
        raise ValueError("costs too large")
    moved: dict = {}
    fields = f"who {held.schema['who'].dataType.simpleString()}, to {kind.simpleString()}, paid long"
    now, rounds = held, 0
    while True:
        if moved:
            over = F.broadcast(spark.createDataFrame([(w, p, c) for w, (p, c) in moved.items()], fields).withColumn("over", F.lit(True)))
            pick = F.col("over").isNotNull()
            now = held.join(over, "who", "left").select("who", F.when(pick, F.col("to")).otherwise(F.col("place")).alias("place"), F.when(pick, F.col("paid")).otherwise(F.col("cost")).alias("cost"))
            if rounds % restage == 0:
                held, moved = staged(now, "held"), {}
                now = held
        mine = now.select("who", F.col("place").alias("from"), F.col("cost").alias("had"))
        moves = pairs.join(mine, "who").where(~F.col("place").eqNullSafe(F.col("from"))).select("who", "from", "place", "cost", "had")
        moves = moves.unionByName(mine.where("from IS NOT NULL").select("who", "from", F.lit(None).cast(kind).alias("place"), F.lit(0).cast("long").alias("cost"), "had"))
        best = moves.groupBy("from", "place").agg(F.min_by(F.struct("who", "cost", "had"), F.struct(F.col("cost") - F.col("had"), "who")).alias("m")).select("from", "place", "m.*").collect()
        w = np.full((out + 1, out + 1), _FAR)
        mover: dict = {}
        for r in best:
            i, j = at.get(r["from"], out), at.get(r["place"], out)
            w[i, j] = r["cost"] - r["had"] + penalty * ((j == out) - (i == out))
            mover[i, j] = (r["who"], r["place"], r["cost"])
        for p, i in at.items():
            for e, open_ in (((i, out), used.get(p, 0) < room[p]), ((out, i), used.get(p, 0) > 0)):
                if open_ and w[e] >= 0:  # free room is taken, or made, without anyone moving
                    w[e] = 0
                    mover.pop(e, None)
        found = False
        while (cycle := _negative_cycle(w)) is not None:
            found = True
            for e in zip(cycle, cycle[1:] + cycle[:1]):
                if e in mover:
                    who, place, cost = mover[e]
                    moved[who] = (place, cost)
                    if e[0] == out:  # whoever comes in can't come in twice
                        for j in range(out):
                            if (out, j) in mover and mover[out, j][0] == who:
                                w[out, j] = _FAR
                    if e[0] != out:
                        used[places[e[0]]] -= 1
                    if e[1] != out:
                        used[places[e[1]]] = used.get(places[e[1]], 0) + 1
            for i in cycle:
                if i != out:
                    w[i, :] = w[:, i] = _FAR
        if not found:
            return now.where("place IS NOT NULL")
        rounds += 1
