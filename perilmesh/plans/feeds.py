"""Queries on hazard feeds and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as S
from ..operators import calibrate as K
from ..sources import feeds
from .domain import EVENTS_SQL, oracle, storm_events, table

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


@query(oracle(EVENTS_SQL, "SELECT n, round(sd / mean, 9) AS beta, CASE WHEN n >= 8 THEN 'FITTED' ELSE 'INSUFFICIENT' END AS status FROM (SELECT count(*) AS n, stddev_samp(total) AS sd, avg(total) AS mean FROM (SELECT year, state, event_type, sum(damage_property::DECIMAL(18,4))::DOUBLE AS total FROM storm_events WHERE damage_property IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(damage_property) > 0))"))
def a27_episode_beta(spark, d):
    return K.episode_beta(storm_events(spark, d), "year", "state", "event_type").withColumn("beta", F.round("beta", 9))


_PAIR = "SELECT event_id, value AS forecast, value * ((event_id * 7 % 13)::DOUBLE / 10 + 0.4) AS observation FROM events"


def _pairs(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").alias("forecast"), (F.col("value") * ((F.col("event_id") * 7 % 13) / F.lit(10.0) + 0.4)).alias("observation"))


@query(oracle(f"pairs AS ({_PAIR})", "SELECT bin, round(sum(forecast::DECIMAL(18,4))::DOUBLE / count(*), 6) AS mean_forecast, round(avg((observation <= forecast)::INT), 9) AS observed, count(*) AS n FROM (SELECT *, floor((forecast - lo) / (hi - lo) * 10)::BIGINT AS bin FROM pairs, (SELECT min(forecast) AS lo, max(forecast) AS hi FROM pairs)) WHERE bin < 10 GROUP BY bin"))
def a31_reliability(spark, d):
    mean = F.round(F.col("mean_forecast") * 1e6) / 1e6  # halves as SQL rounds them: by the scaled number, not by its decimal digits
    return K.reliability(_pairs(spark, d)).select("bin", mean.alias("mean_forecast"), F.round("observed", 9).alias("observed"), "n")


@query("SELECT b AS bin, count(x) AS n FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT (event_id % 101)::DOUBLE / 100 AS x FROM events) ON least(floor(x * 10), 9) = b GROUP BY b")
def a32_pit_histogram(spark, d):
    return K.histogram(table(spark, d, "events").select(((F.col("event_id") % 101) / F.lit(100.0)).alias("x")), 10)


@query("SELECT b AS bin, count(x) AS n FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT value AS x FROM events) ON least(floor(least(x / 300, 1::DOUBLE) * 10), 9) = b GROUP BY b")
def a33_distance_histogram(spark, d):
    return K.distance_histogram(table(spark, d, "events").select(F.col("value").alias("x")), 30.0, 10)


@query(oracle(f"pairs AS ({_PAIR})", "SELECT " + ", ".join(f"round(avg(greatest({q}::DOUBLE * (observation - forecast), ({q}::DOUBLE - 1) * (observation - forecast))), 6) AS {n}" for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))) + ", round(avg(abs(observation - forecast)), 6) AS mae, round(sqrt(avg(pow(observation - forecast, 2))), 6) AS rmse FROM pairs"))
def a34_pinball(spark, d):
    e = F.col("observation") - F.col("forecast")
    return _pairs(spark, d).agg(*(F.round(K.pinball("observation", "forecast", q), 6).alias(n) for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(F.pow(e, 2))), 6).alias("rmse"))


_ERR = "SELECT 2010 + event_id % 14 AS year, (12 * (1 + event_id % 10))::INT AS hour, value - 120 AS error FROM events"


@query(oracle(f"e AS ({_ERR})", """SELECT hour, "window", count(*) AS n, round(stddev_samp(error), 6) AS sd, round(avg(abs(error)), 6) AS mae, round(quantile_cont(abs(error), 0.67), 6) AS p67 FROM (SELECT *, 'full' AS "window" FROM e UNION ALL SELECT *, 'recent' FROM e WHERE year >= 2019) GROUP BY 1, 2"""))
def a30_error_stats(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select((2010 + e % 14).alias("year"), (12 * (1 + e % 10)).cast("int").alias("hour"), (F.col("value") - 120).alias("error"))
    return K.error_stats(rows, 2019).select("hour", "window", "n", *(F.round(c, 6).alias(c) for c in ("sd", "mae", "p67")))


_BUCKET = "CASE " + " ".join(f"WHEN mph >= {lo} AND mph < {hi} THEN '{n}'" for (lo, n), (hi, _) in zip(X.STORM_BUCKETS, [*X.STORM_BUCKETS[1:], (1000000000, "")])) + " END"
_FREQ = f"own AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT value * {X.KNOTS_TO_MPH}::DOUBLE / 2 AS mph FROM events) GROUP BY 1 HAVING {_BUCKET} IS NOT NULL)"


@query(oracle(_FREQ, "SELECT d.bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM own)::DOUBLE, 9) AS share FROM (VALUES " + ", ".join(f"('{b}')" for _, b in X.STORM_BUCKETS) + ") d(bucket) LEFT JOIN own USING (bucket)"))
def a28_basin_frequencies(spark, d):
    return K.bucket_frequencies(table(spark, d, "events").select((F.col("value") * X.KNOTS_TO_MPH / 2).alias("mph")))


@query(oracle("c AS (SELECT event_type, count(*) AS n, (1 + length(event_type))::DOUBLE / 40 AS p FROM events GROUP BY event_type)", "SELECT round(sum(n * ln(p)), 6) AS ll FROM c"))
def a29_log_likelihood(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("p", (1 + F.length("event_type")) / F.lit(40.0))
    return K.log_likelihood(rows).select(F.round("ll", 6).alias("ll"))


@query("SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(1.96::DOUBLE * stddev_samp(x) / sqrt(count(*)), 6) AS half, round(max(x) - avg(x), 6) AS gap FROM (SELECT s_acctbal AS x FROM supplier)")
def a40_envelope(spark, d):
    return K.envelope(table(spark, d, "supplier").select(F.col("s_acctbal").alias("x"))).select(*(F.round(c, 6).alias(c) for c in ("mean", "sd", "half", "gap")))


_MONTHS = "months AS (SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders), vals AS (SELECT 1992 + c_custkey % 7 AS year, 1 + c_custkey * 5 % 12 AS month, round(avg(c_acctbal) / 5000 - 1, 6) AS value FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1, 2)"


@query(oracle(_MONTHS, "SELECT m.year, m.month, v.value, CASE WHEN v.value >= 0.5 THEN 'nino' WHEN v.value <= -0.5 THEN 'nina' ELSE 'neutral' END AS enso FROM (SELECT year, month, (SELECT max(v.year * 12 + v.month) FROM vals v WHERE v.year * 12 + v.month <= m.year * 12 + m.month) AS at FROM months m) m LEFT JOIN vals v ON v.year * 12 + v.month = m.at"))
def j14_regime_as_of(spark, d):
    k = F.col("c_custkey")
    vals = table(spark, d, "customer").where(k % 3 == 0).groupBy((1992 + k % 7).alias("year"), (1 + k * 5 % 12).alias("month")).agg(F.round(F.avg("c_acctbal") / 5000 - 1, 6).alias("value"))
    months = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).distinct()
    return K.latest_at(vals, months).select("year", "month", "value", K.regime(F.lit(0.0), "value")[1].alias("enso"))


@query("SELECT o_orderkey AS n, (o_orderkey + 7) % 21 AS member FROM orders")
def w9_round_robin(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.pmod(F.col("o_orderkey") + 7, F.lit(21)).cast("long").alias("member"))


@query(None)
def w10_stratified_sample(spark, d):
    """Ten winds per storm class, from hashed uniform numbers inside the class."""
    buckets = spark.createDataFrame([(i, b, float(lo), float(hi)) for i, ((lo, b), hi) in enumerate(zip(X.STORM_BUCKETS, (74, 96, 111, 130, 180)))], "i long, bucket string, lo double, hi double")
    rows = buckets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return rows.select("bucket", "k", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * S.lcg(F.col("i") * 1000 + F.col("k")), 3).alias("mph"))


@query(oracle("u AS (SELECT s_suppkey AS n, k, ((" + "((((s_suppkey * 100 + k) * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648" + ") * 1103515245 + 12345) % 2147483648 AS r FROM supplier, (SELECT unnest(range(5)) AS k))", "SELECT n, k, [10, 20, 30, 40, 50, 60, 70][floor(r::DOUBLE / 2147483648 * 7)::INT + 1]::INT AS drawn FROM u"))
def w11_bootstrap(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k"))
    pool = F.array(*map(F.lit, (10, 20, 30, 40, 50, 60, 70)))
    return rows.select("n", "k", F.element_at(pool, (F.floor(S.lcg(F.col("n") * 100 + F.col("k")) * 7) + 1).cast("int")).alias("drawn"))


#: A small best-track file: three storms, a depression row among them.
TRACKS = """AL012001, ALPHA, 4,
20010601, 0000,  , TS, 25.0N,  80.0W,  45, 1000,
20010601, 0600, L, HU, 26.0N,  81.0W,  75,  980,
20010601, 0630,  , HU, 26.1N,  81.1W,  75,  980,
20010601, 1200,  , TD, 27.0N,  82.0W,  25, 1005,
AL022001, BETA, 3,
20010801, 0000,  , TS, 20.0N,  60.0W,  40, 1002,
20010801, 0600,  , HU, 21.0N,  61.5W, 100,  950,
20010801, 1200, L, HU, 22.0N,  63.0W, -99,  950,
AL032001, GAMMA, 1,
20010901, 1800, L, TS, 30.5N,  88.0W,  50,  999,"""


@query("""SELECT * FROM (VALUES ('AL012001', 'ALPHA', '2001-06-01 00:00', 25.0::DOUBLE, -80.0::DOUBLE, 45, 'TS', ''), ('AL012001', 'ALPHA', '2001-06-01 06:00', 26.0, -81.0, 75, 'HU', 'L'), ('AL012001', 'ALPHA', '2001-06-01 06:30', 26.1, -81.1, 75, 'HU', ''),
 ('AL022001', 'BETA', '2001-08-01 00:00', 20.0, -60.0, 40, 'TS', ''), ('AL022001', 'BETA', '2001-08-01 06:00', 21.0, -61.5, 100, 'HU', ''), ('AL032001', 'GAMMA', '2001-09-01 18:00', 30.5, -88.0, 50, 'TS', 'L')) t(storm_id, name, ts, lat, lon, max_wind_kts, system_status, record_identifier)""")
def s4_best_tracks(spark, d):
    lines = spark.createDataFrame([("best.txt", i, line) for i, line in enumerate(TRACKS.split("\n"))], "file string, line int, value string")
    return feeds.parse_hurdat2(lines).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@query("SELECT 1992 + c_custkey % 7 AS year, 1 + c_custkey % 12 AS month, round(c_acctbal / 1000, 2) AS value FROM customer WHERE c_custkey % 5 <> 0")
def s5_monthly_index(spark, d):
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, "-99.99").otherwise(F.round(F.col("c_acctbal") / 1000, 2).cast("string"))
    lines = table(spark, d, "customer").select(F.concat_ws("  ", (1992 + k % 7).cast("string"), (1 + k % 12).cast("string"), value).alias("value"))
    return feeds.parse_amo(lines).select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "value")


@query("SELECT 1950 + n_nationkey AS year, m AS month, (n_nationkey * 10 + m)::DOUBLE / 10 AS value FROM nation, (SELECT unnest(range(1, 13)) AS m) WHERE (n_nationkey + m) % 6 <> 0")
def s6_yearly_index(spark, d):
    k = F.col("n_nationkey")
    cells = [F.when((k + m) % 6 == 0, "-99.9").otherwise(((k * 10 + m) / F.lit(10.0)).cast("string")) for m in range(1, 13)]
    lines = table(spark, d, "nation").select(F.concat_ws(" ", (1950 + k).cast("string"), *cells).alias("value"))
    return feeds.parse_oni(lines).select(F.col("year"), F.col("month").cast("long").alias("month"), "value")


@query("SELECT 'AP' || lpad((s_suppkey % 3)::VARCHAR, 2, '0') AS member, count(DISTINCT (s_suppkey % 20) * 6) AS points FROM supplier GROUP BY 1")
def s8_ensemble_members(spark, d):
    k = F.col("s_suppkey")
    lines = table(spark, d, "supplier").select(F.concat_ws(", ", F.lit("AL"), F.lit("09"), F.lit("2024090100"), F.lit("03"), F.concat(F.lit("AP"), F.lpad((k % 3).cast("string"), 2, "0")), ((k % 20) * 6).cast("string"), F.lit("285N"), F.lit("0821W"), F.lit("65")).alias("value"))
    return feeds.parse_adeck(lines).select("member", F.size("track").cast("long").alias("points"))


@query("SELECT n_regionkey AS disaster, min_by(n_name, n_nationkey) AS title, string_agg(n_name, '|' ORDER BY n_nationkey) AS counties FROM nation GROUP BY 1")
def s10_declarations(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("disaster"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("seq"), F.concat("n_name", F.lit(" (County)")).alias("county"))
    return feeds.parse_declarations(rows.unionByName(rows.where("seq % 2 = 0"))).select("disaster", "title", F.array_join("counties", "|").alias("counties"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 400 THEN NULL ELSE value * 10 END AS elevation FROM events")
def s14_elevations(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, "-1000000").when(F.col("value") > 400, "6000").otherwise((F.col("value") * 10).cast("string"))
    return table(spark, d, "events").select("event_id", feeds.elevation(F.concat(F.lit('{"value": "'), v, F.lit('"}'))).alias("elevation"))


@query("SELECT r_name AS event, 'Severe' AS severity, NULL::VARCHAR AS area, CASE WHEN r_regionkey % 2 = 0 THEN 'Polygon' END AS geometry FROM region WHERE r_regionkey > 0")
def s11_alerts(spark, d):
    rows = table(spark, d, "region").select(F.format_string('{"properties": {"event": "%s", "severity": "Severe"}, "geometry": {"type": "%s"}}', "r_name", F.when(F.col("r_regionkey") % 2 == 0, "Polygon").otherwise("Point")).alias("value"), "r_name", "r_regionkey")
    names = [r[0] for r in table(spark, d, "region").where("r_regionkey > 0").select("r_name").limit(20).collect()]
    return feeds.parse_alerts(rows, names)


@query("SELECT event_type, count(*) AS n, date_trunc('hour', ts)::VARCHAR AS hour FROM events GROUP BY 1, 3")
def x1_hourly_events(spark, d):
    """Extension: tumbling windows over the event stream, as a batch."""
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", "n", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"))
