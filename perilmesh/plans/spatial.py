"""Queries on areas with holes, buildings in chips and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rings as R
from ..functions import scalars as S
from ..operators import perils as P
from ..operators import spatial as G
from .domain import ANCHORS_SQL, BOOK, anchors, oracle, policies, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _buildings(spark, d):
    """A building per customer: a box of its own size near an anchor, every fifth one with a court."""
    k, w, h = F.col("c_custkey"), F.col("w"), F.col("h")
    rows = table(spark, d, "customer").join(F.broadcast(anchors(spark)), k % 38 == F.col("i")).select(
        k.alias("building_id"), ((1 + k % 9) / F.lit(1e5)).alias("w"), ((1 + k % 4) / F.lit(1e5)).alias("h"),
        (F.col("alat") + (k * 29 % 361 - 180) / F.lit(1000.0)).alias("lat"), (F.col("alon") + (k * 31 % 361 - 180) / F.lit(1000.0)).alias("lon"))
    x, y = F.col("lon"), F.col("lat")
    outer, court = R.box_ring(x - w, y - h, x + w, y + h), R.box_ring(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    return rows.select("building_id", "lat", "lon", F.array(F.when(F.col("building_id") % 5 == 0, F.array(outer, court)).otherwise(F.array(outer))).alias("area"))


_BUILDINGS_SQL = """buildings AS (SELECT *, 4 * 3.141592653589793::DOUBLE * (4 * w * h - CASE WHEN id % 5 = 0 THEN w * h ELSE 0 END) / pow(4 * (w + h) + CASE WHEN id % 5 = 0 THEN 2 * (w + h) ELSE 0 END, 2) AS pp
  FROM (SELECT c_custkey AS id, (1 + c_custkey % 9)::DOUBLE / 1e5 AS w, (1 + c_custkey % 4)::DOUBLE / 1e5 AS h, alat + (c_custkey * 29 % 361 - 180)::DOUBLE / 1000 AS lat, alon + (c_custkey * 31 % 361 - 180)::DOUBLE / 1000 AS lon
   FROM customer JOIN anchors ON i = c_custkey % 38))"""
_CHIPS_SQL = "chips AS (SELECT id, lat, lon, 1280::DOUBLE / 111320 AS dy, 1280::DOUBLE / (111320 * cos(radians(lat)) + 1e-9) AS dx FROM policies)"


@query(oracle(*BOOK, _BUILDINGS_SQL, _CHIPS_SQL, """found AS (SELECT c.id, b.pp FROM chips c JOIN buildings b ON b.lon >= c.lon - c.dx AND b.lon <= c.lon + c.dx AND b.lat >= c.lat - c.dy AND b.lat <= c.lat + c.dy)""",
    "SELECT id AS chip_id, round(coalesce(1 - avg(pp), 0), 6) AS value, count(pp) AS n_buildings FROM (SELECT id FROM chips) LEFT JOIN found USING (id) GROUP BY 1"))
def j21_chip_roofs(spark, d):
    chips = policies(spark, d).select(F.col("id").alias("chip_id"), R.chip_box("lat", "lon").alias("box"))
    return G.roof_complexity(_buildings(spark, d), chips).withColumn("value", F.round("value", 6))


def _quadkey_sql(rows: str) -> str:
    x = "least(511, greatest(0, floor((lon + 180) / 360 * 512)))::INT"
    y = "least(511, greatest(0, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * 3.141592653589793::DOUBLE)) * 512)))::INT"
    return "SELECT " + " || ".join(f"((x >> {z}) % 2 + 2 * ((y >> {z}) % 2))::VARCHAR" for z in range(8, -1, -1)) + f" AS quadkey FROM (SELECT {x} AS x, {y} AS y FROM {rows})"


@query(oracle(*BOOK, _BUILDINGS_SQL, f"need AS (SELECT quadkey, count(*) AS n_policies FROM ({_quadkey_sql('policies WHERE id % 6 <> 0')}) GROUP BY 1), held AS (SELECT quadkey, count(*) AS n_buildings FROM ({_quadkey_sql('buildings WHERE id % 38 < 30')}) GROUP BY 1)",
    "SELECT quadkey, n_policies, coalesce(n_buildings, 0) AS n_buildings, CASE WHEN n_buildings IS NULL THEN n_policies ELSE 0 END AS n_failed FROM need LEFT JOIN held USING (quadkey)"))
def j20_shards(spark, d):
    """Shards of buildings that policies need; every sixth policy is done, and eight anchors have no shards of their own."""
    book = policies(spark, d)
    return G.shards(book, _buildings(spark, d).where("building_id % 38 < 30"), book.where("id % 6 = 0"))


def _areas(spark, d):
    """An area per nation: a box with a hole around its anchor, and a second part to the east."""
    k, x, y = F.col("n_nationkey"), F.col("alon"), F.col("alat")
    half, hole = (100 + 2 * k) / F.lit(1000.0), (40 + k) / F.lit(1000.0)
    parts = F.array(F.array(R.box_ring(x - half, y - half, x + half, y + half), R.box_ring(x - hole, y - hole, x + hole, y + hole)), F.array(R.box_ring(x + 0.14, y - 0.09, x + 0.17, y + 0.16)))
    return table(spark, d, "nation").join(anchors(spark), k == F.col("i")).select(k.alias("nation"), "zip3", "alat", "alon", parts.alias("area"))


_AREAS_SQL = "areas AS (SELECT n_nationkey AS nation, zip3, alat, alon, (100 + 2 * n_nationkey)::DOUBLE / 1000 AS half, (40 + n_nationkey)::DOUBLE / 1000 AS hole FROM nation JOIN anchors ON i = n_nationkey)"
_IN_BOX = "(lon >= alon - {0} AND lon < alon + {0} AND lat >= alat - {0} AND lat < alat + {0})"


@query(oracle(*BOOK, _AREAS_SQL, f"""SELECT nation, count(*) AS n, sum(tiv::DECIMAL(18,4))::DOUBLE AS tiv FROM areas JOIN policies USING (zip3)
 WHERE ({_IN_BOX.format('half')} AND NOT {_IN_BOX.format('hole')}) OR (lon >= alon + 0.14::DOUBLE AND lon < alon + 0.17::DOUBLE AND lat >= alat - 0.09::DOUBLE AND lat < alat + 0.16::DOUBLE) GROUP BY nation"""))
def f12_areas_with_holes(spark, d):
    """Exposure in areas of several parts with holes."""
    rows = policies(spark, d).join(F.broadcast(_areas(spark, d).select("nation", "zip3", "area")), "zip3").where(R.in_area("lon", "lat", "area"))
    return rows.groupBy("nation").agg(F.count("*").alias("n"), S.money_sum("tiv").alias("tiv"))


@query(oracle(ANCHORS_SQL, _AREAS_SQL, """SELECT nation, round(a, 9) AS area, round(p, 9) AS perimeter, round(4 * 3.141592653589793::DOUBLE * a / (p * p), 9) AS compactness, round(alon + mx / a, 6) AS x, round(alat + my / a, 6) AS y
 FROM (SELECT *, 4 * half * half - 4 * hole * hole + 0.03::DOUBLE * 0.25::DOUBLE AS a, 8 * half + 8 * hole + 0.56::DOUBLE AS p, 0.0075::DOUBLE * 0.155::DOUBLE AS mx, 0.0075::DOUBLE * 0.035::DOUBLE AS my FROM areas)"""))
def a42_ring_compactness(spark, d):
    """Area, perimeter, compactness and centre of areas of several parts with holes."""
    rows = _areas(spark, d).select("nation", R.moments("area").alias("m"), R.perimeter("area").alias("p"))
    return rows.select("nation", F.round("m.area", 9).alias("area"), F.round("p", 9).alias("perimeter"), F.round(P.polsby_popper("m.area", "p"), 9).alias("compactness"), F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query(oracle(*BOOK, """SELECT tile, count(*) AS n FROM (SELECT CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(abs(la)::VARCHAR, 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lo)::VARCHAR, 3, '0') AS tile
 FROM (SELECT (floor(lat / 3) * 3)::INT AS la, (floor(lon / 3) * 3)::INT AS lo FROM policies)) GROUP BY tile"""))
def f16_tiles(spark, d):
    return policies(spark, d).groupBy(R.tile_corner("lat", "lon").alias("tile")).agg(F.count("*").alias("n"))
