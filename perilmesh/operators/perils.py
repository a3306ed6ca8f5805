"""Scenario generators of perils, by inverse distributions on hashed uniform numbers: n rows, no randomness besides the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import _c, lcg, mmi_radius_km, normal

# Distributions (fixed values): hail stones in mm, seismic regions, fire severities, winter severities and regions.
STONES = [(25.0, 35.0, 0.55), (35.0, 50.0, 0.25), (50.0, 70.0, 0.13), (70.0, 100.0, 0.06), (100.0, 120.0, 0.01)]
HAIL_BOX = (28.0, 47.0, -105.0, -86.0)
SEISMIC = [("california", 0.55, (32.5, 42.0, -125.0, -114.0)), ("pnw", 0.10, (41.0, 49.0, -125.0, -116.0)), ("intermountain", 0.10, (36.0, 46.0, -118.0, -109.0)), ("new_madrid", 0.05, (35.0, 38.5, -91.5, -88.5)), ("alaska", 0.20, (54.0, 65.0, -165.0, -130.0))]
MAGNITUDE, GR_B = (5.53, 8.0), 1.0
FIRES = [("low", 0.20), ("moderate", 0.55), ("high", 0.25)]
FIRE_MEDIAN, FIRE_SIGMA, FIRE_ACRES, FIRE_BOX = 2000.0, 1.6, (300.0, 1_000_000.0), (31.0, 49.0, -124.0, -103.0)
WINTER = [("limited", 0.50), ("minor", 0.30), ("moderate", 0.12), ("major", 0.06), ("extreme", 0.02)]
WINTER_REGIONS = [("polar_vortex", 0.35, (28.0, 47.0, -105.0, -82.0)), ("lake_effect", 0.25, (40.0, 47.0, -90.0, -73.0)), ("ice_storm", 0.40, (30.0, 42.0, -95.0, -75.0))]


def scenario_seed(name) -> Column:
    """32-bit seed of a scenario's name, at least 1."""
    h = F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise((a * 1315423911 % 4294967296).bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.greatest(h, F.lit(1).cast("long"))


def uniform(seed: int, stream: int) -> Column:
    return lcg((F.col("k") + seed % 100_000) * 8 + stream)


def pick(u: Column, options: list[tuple]) -> Column:
    """The option in whose share of [0, 1) u falls: (name, weight, ...)."""
    at, out = 0.0, None
    for name, weight, *_ in options[:-1]:
        at += weight
        out = F.when(u < round(at, 9), name) if out is None else out.when(u < round(at, 9), name)
    return out.otherwise(options[-1][0])


def _within(u: Column, low, high) -> Column:
    return F.round(low + (high - low) * u, 4)


def hail(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Hail stones in mm by size class, anywhere in the hail belt."""
    rows = spark.range(n).select(F.col("id").alias("k"))
    u, v = uniform(seed, 0), uniform(seed, 1)
    classes = [(i, w) for i, (_, _, w) in enumerate(STONES)]
    at = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in STONES)), (pick(u, classes) + 1).cast("int"))
    return rows.select("k", F.round(at(0) + (at(1) - at(0)) * v, 0).alias("diameter_mm"), _within(uniform(seed, 2), HAIL_BOX[0], HAIL_BOX[1]).alias("lat"), _within(uniform(seed, 3), HAIL_BOX[2], HAIL_BOX[3]).alias("lon"))


def earthquakes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Magnitudes by a truncated Gutenberg-Richter law, in closed form, with the radius of intensity 6."""
    rows = spark.range(n).select(F.col("id").alias("k")).withColumn("region", pick(uniform(seed, 0), SEISMIC))
    span = 1 - 10 ** (-GR_B * (MAGNITUDE[1] - MAGNITUDE[0]))
    m = F.round(MAGNITUDE[0] - F.log10(1 - uniform(seed, 1) * span) / GR_B, 2)
    side = lambda j: _box("region", SEISMIC, j)
    rows = rows.select("k", "region", m.alias("magnitude"), _within(uniform(seed, 2), side(0), side(1)).alias("lat"), _within(uniform(seed, 3), side(2), side(3)).alias("lon"))
    return rows.withColumn("mmi6_km", F.round(mmi_radius_km("magnitude", F.lit(6.0)), 2))


def _box(column: str, regions: list[tuple], j: int) -> Column:
    out = None
    for name, _, box in regions:
        out = F.when(_c(column) == name, box[j]) if out is None else out.when(_c(column) == name, box[j])
    return out


def wildfires(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("k"))
    z = normal((F.col("k") + seed % 100_000) * 8 + 1)
    acres = F.greatest(F.lit(FIRE_ACRES[0]), F.least(F.lit(FIRE_ACRES[1]), FIRE_MEDIAN * F.exp(FIRE_SIGMA * z)))
    return rows.select("k", pick(uniform(seed, 0), FIRES).alias("severity"), F.round(acres, 2).alias("acres"), _within(uniform(seed, 2), FIRE_BOX[0], FIRE_BOX[1]).alias("lat"), _within(uniform(seed, 3), FIRE_BOX[2], FIRE_BOX[3]).alias("lon"))


def freezes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("k")).withColumn("region", pick(uniform(seed, 1), WINTER_REGIONS))
    side = lambda j: _box("region", WINTER_REGIONS, j)
    return rows.select("k", pick(uniform(seed, 0), WINTER).alias("severity"), "region", _within(uniform(seed, 2), side(0), side(1)).alias("lat"), _within(uniform(seed, 3), side(2), side(3)).alias("lon"))


#: Perils by name; add to it to plug in another one: (spark, n, seed) to a DataFrame.
GENERATORS: dict[str, Callable[..., DataFrame]] = {"hail": hail, "earthquake": earthquakes, "wildfire": wildfires, "winter": freezes}


def perturbed_tracks(track: DataFrame, n: int, r67_per_hour: float = 1.2) -> DataFrame:
    """(k, hours, lat, lon): n copies of a track (hours, lat, lon), each point moved by a normal whose spread grows with lead time.

    The 67 % radius r gives the spread r / sqrt(-2 ln 0.33) per axis; east-west moves are widened by latitude.
    """
    km = (r67_per_hour * F.col("hours") + 20) * 1.852 * 0.6715597
    rows = track.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    key = F.col("k") * 1000 + F.col("hours").cast("long")
    east = F.greatest(F.lit(0.1), F.cos(F.radians("lat")))
    return rows.select("k", "hours", F.round(F.col("lat") + km / 111 * normal(key * 2), 6).alias("lat"), F.round(F.col("lon") + km / 111 / east * normal(key * 2 + 1), 6).alias("lon"))


def circle(lat, lon, radius_km, points: int = 32) -> Column:
    """A closed ring of (x, y) around a point."""
    turn = 2 * 3.141592653589793 / points
    east = F.greatest(F.lit(0.1), F.cos(F.radians(_c(lat))))
    corner = lambda i: F.struct((_c(lon) + _c(radius_km) / 111 / east * F.cos(i * turn)).alias("x"), (_c(lat) + _c(radius_km) / 111 * F.sin(i * turn)).alias("y"))
    open_ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), corner)
    return F.concat(open_ring, F.slice(open_ring, 1, 1))


def polsby_popper(area, perimeter) -> Column:
    """Compactness of a polygon, 0 to 1."""
    return F.when(_c(perimeter) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 4 * 3.141592653589793 * _c(area) / (_c(perimeter) * _c(perimeter))))).otherwise(0.0)


def convex_hulls(points: DataFrame, *keys: str) -> DataFrame:
    """The convex hull of each group's points (lon, lat), as a closed ring in counter-clockwise order.

    Only the lowest and highest point at each longitude can be on a hull; groups are reduced to those
    by an aggregation first.
    """
    import pandas as pd

    ends = points.groupBy(*keys, "lon").agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"))
    edge = ends.select(*keys, "lon", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("lat"))

    def hull(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(frame["lon"], frame["lat"])))
        if len(pts) >= 3:
            halves = []
            for order in (pts, pts[::-1]):
                half: list[tuple[float, float]] = []
                for p in order:
                    while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                        half.pop()
                    half.append(p)
                halves.append(half[:-1])
            pts = halves[0] + halves[1]
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "ring": [[{"x": x, "y": y} for x, y in [*pts, pts[0]]]]})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields if f.name in keys)
    return edge.groupBy(*keys).applyInPandas(hull, f"{fields}, ring array<struct<x:double,y:double>>")
