"""Buildings in image chips, and the shards that they are read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rings import moments, perimeter
from ..functions.scalars import quadkey
from .perils import polsby_popper

#: Finest level of the cells: 360 degrees halved so often.
FINEST = 20


def _cell(level: Column, v: Column) -> Column:
    return F.floor((v + 180) / (F.lit(360.0) / F.pow(F.lit(2.0), level))).cast("long")


def covered(boxes: DataFrame) -> DataFrame:
    """``boxes`` (struct box: left, low, right, high) with a row per (level, cx, cy) that covers them.

    The level is the finest whose cells are as wide as the box is, so a box has at most four cells, whatever its size.  A box with a
    null or turned side has none.
    """
    b = F.col("box")
    size = F.greatest(b["right"] - b["left"], b["high"] - b["low"])
    level = F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / size)))).cast("int")).otherwise(FINEST)
    rows = boxes.where((b["right"] >= b["left"]) & (b["high"] >= b["low"])).withColumn("level", level)
    rows = rows.withColumn("cx", F.explode(F.sequence(_cell(F.col("level"), b["left"]), _cell(F.col("level"), b["right"]))))
    return rows.withColumn("cy", F.explode(F.sequence(_cell(F.col("level"), b["low"]), _cell(F.col("level"), b["high"]))))


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (x, y and more) with each box (box and more) that holds them, borders included, once per pair.

    A box lies at one level and a point in one cell of a level, so a pair meets in one cell only: an equi-join with the exact test behind
    it.  Points are repeated only for the levels that boxes have (at most 21, the one thing collected).  Crowded cells are split by AQE.
    """
    cells = covered(boxes)
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn("cx", _cell(F.col("level"), F.col("x"))).withColumn("cy", _cell(F.col("level"), F.col("y")))
    b = F.col("box")
    return cells.join(placed, ["level", "cx", "cy"]).where(F.col("x").between(b["left"], b["right"]) & F.col("y").between(b["low"], b["high"])).drop("level", "cx", "cy")


def roof_complexity(buildings: DataFrame, chips: DataFrame) -> DataFrame:
    """Per chip (chip_id, unique; box) how jagged its buildings (area: parts of rings) are: 1 less the mean compactness, and their number.

    A building belongs to the chips that its centre of mass is in.  Chips without one have 0 and 0.  Every building counts: the source
    system stops at 5000 of a chip.
    """
    m = buildings.select(moments("area").alias("m"), perimeter("area").alias("p"))
    points = m.select(F.col("m.x").alias("x"), F.col("m.y").alias("y"), polsby_popper("m.area", "p").alias("pp"))
    found = points_in_boxes(points, chips.select("chip_id", "box")).select("chip_id", "pp").unionByName(chips.select("chip_id", F.lit(None).cast("double").alias("pp")))
    return found.groupBy("chip_id").agg(F.coalesce(1 - F.avg("pp"), F.lit(0.0)).alias("value"), F.count("pp").alias("n_buildings"))


def shards(policies: DataFrame, buildings: DataFrame, done: DataFrame, zoom: int = 9) -> DataFrame:
    """Per shard (quadkey) that policies (id, lat, lon) not yet ``done`` (id) need: their number, its buildings (lat, lon), and how many policies fail as it has none.

    Both sides are counted before they meet, so each shard is read once and only counts are joined.
    """
    need = policies.join(done.select("id"), "id", "left_anti").groupBy(quadkey("lat", "lon", zoom).alias("quadkey")).agg(F.count("*").alias("n_policies"))
    held = buildings.groupBy(quadkey("lat", "lon", zoom).alias("quadkey")).agg(F.count("*").alias("n_buildings"))
    n = F.coalesce("n_buildings", F.lit(0)).cast("long")
    return need.where("quadkey IS NOT NULL").join(held, "quadkey", "left").select("quadkey", "n_policies", n.alias("n_buildings"), F.when(n == 0, F.col("n_policies")).otherwise(0).cast("long").alias("n_failed"))
