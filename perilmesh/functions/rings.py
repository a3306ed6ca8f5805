"""Areas with holes and several parts as Column expressions.

A ring is a closed array of structs (x, y); a part is an array of rings, the outer one first and then its holes; an area is an array of parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import _c, in_ring

AREA = "array<array<array<struct<x:double,y:double>>>>"


def in_area(x, y, area) -> Column:
    """Whether the point is in some part: inside an odd number of the part's rings, so that holes are outside; null areas hold nothing."""
    inside = F.exists(_c(area), lambda part: F.aggregate(part, F.lit(False), lambda acc, ring: acc != in_ring(x, y, ring)))
    return F.coalesce(inside, F.lit(False))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.when(n >= 4, F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b")))


def _sum(values: Column) -> Column:
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))


def perimeter(area) -> Column:
    """The length of all rings, holes included."""
    lengths = F.transform(F.flatten(_c(area)), lambda r: _sum(F.transform(_edges(r), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))))
    return _sum(lengths)


def _once(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _added(rows: Column) -> Column:
    return F.aggregate(rows, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q))


def moments(area) -> Column:
    """(area, x, y): the plane area less the holes, and the centre of mass; a centre is null where the area is 0.

    Taken about the first point, so that small areas far from the origin keep their digits; either direction of a ring will do.
    """
    area = _c(area)
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def of_area(o: Column) -> Column:
        def of_edge(p: Column) -> Column:
            ax, ay, bx, by = (F.get(p, F.lit(i)) for i in range(4))
            return _once(ax * by - bx * ay, lambda cross: F.array(cross / 2, (ax + bx) * cross / 6, (ay + by) * cross / 6))

        def of_ring(ring: Column, i: Column) -> Column:
            shifted = F.transform(_edges(ring), lambda e: F.array(e["a"]["x"] - o["x"], e["a"]["y"] - o["y"], e["b"]["x"] - o["x"], e["b"]["y"] - o["y"]))
            own = F.coalesce(_added(F.transform(shifted, of_edge)), zero)
            sign = F.when(i == 0, 1.0).otherwise(-1.0)
            return _once(own, lambda t: _once(sign * F.when(F.get(t, F.lit(0)) < 0, -1.0).otherwise(1.0), lambda f: F.transform(t, lambda v: v * f)))

        total = F.coalesce(_added(F.flatten(F.transform(area, lambda part: F.transform(part, of_ring)))), zero)
        mean = lambda t, i, c: o[c] + F.try_divide(F.get(t, F.lit(i)), F.get(t, F.lit(0)))
        return _once(total, lambda t: F.struct(F.get(t, F.lit(0)).alias("area"), mean(t, 1, "x").alias("x"), mean(t, 2, "y").alias("y")))

    return _once(F.get(F.get(F.get(area, F.lit(0)), F.lit(0)), F.lit(0)), of_area)


def box_ring(left, low, right, high) -> Column:
    """The closed ring of a box."""
    corners = ((left, low), (right, low), (right, high), (left, high), (left, low))
    return F.array(*(F.struct(_c(x).alias("x"), _c(y).alias("y")) for x, y in corners))


def chip_box(lat, lon, pixels: int = 256, resolution_m: float = 10.0) -> Column:
    """(left, low, right, high) in degrees of an image chip centred at a point."""
    half = pixels * resolution_m / 2
    dy = F.lit(half / 111_320.0)
    dx = half / (111_320.0 * F.cos(F.radians(_c(lat))) + 1e-9)
    return F.struct((_c(lon) - dx).alias("left"), (_c(lat) - dy).alias("low"), (_c(lon) + dx).alias("right"), (_c(lat) + dy).alias("high"))


def tile_corner(lat, lon, degrees: int = 3) -> Column:
    """The name of the tile of ``degrees`` that holds a point: its south-west corner, as in N27W084."""
    def part(v: Column, plus: str, minus: str, width: int) -> Column:
        s = (F.floor(v / degrees) * degrees).cast("int")
        return F.concat(F.when(s >= 0, plus).otherwise(minus), F.lpad(F.abs(s).cast("string"), width, "0"))

    return reduce(F.concat, (part(_c(lat), "N", "S", 2), part(_c(lon), "E", "W", 3)))
