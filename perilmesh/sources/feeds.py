"""Parsers of hazard feeds: text lines in, typed rows out, all in DataFrame expressions.

Each takes a DataFrame with a string column ``value`` (as spark.read.text gives it) and, where lines
belong together, (file, line) to order them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files: a file is one row until it is split, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return whole.where("value <> ''")


def coordinate(token) -> Column:
    """Degrees of '28.5N' or '82.1W'; south and west are negative; null for anything else."""
    token = F.upper(F.trim(token))
    sign = F.when(F.substring(token, -1, 1).isin("S", "W"), -1.0).when(F.substring(token, -1, 1).isin("N", "E"), 1.0)
    return F.regexp_replace(token, "[NSEW]$", "").try_cast("double") * sign


def parse_hurdat2(lines: DataFrame) -> DataFrame:
    """Track rows of a HURDAT2 file: storm_id, name, ts, lat, lon, max_wind_kts, system_status, record_identifier.

    A storm's header says how many rows follow, which are its track; each row takes the last header above it.
    Only tropical storms and hurricanes with a known wind are kept.
    """
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.withColumn("c", cells).withColumn("header", F.col("value").rlike("^[A-Z]{2}[0-9]{6},"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("h", F.last(F.when(F.col("header"), F.struct(F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).alias("name"))), ignorenulls=True).over(w))
    c = lambda i: F.get("c", F.lit(i))
    out = rows.where("NOT header AND h IS NOT NULL").select(
        F.col("h.id").alias("storm_id"), F.col("h.name").alias("name"), F.to_timestamp(F.concat(c(0), c(1)), "yyyyMMddHHmm").alias("ts"), coordinate(c(4)).alias("lat"), coordinate(c(5)).alias("lon"),
        c(6).try_cast("int").alias("max_wind_kts"), c(3).alias("system_status"), c(2).alias("record_identifier"),
    )
    return out.where(F.col("system_status").isin("TS", "HU") & (F.col("max_wind_kts") >= 0))


def landfalls(track: DataFrame) -> DataFrame:
    return track.where("record_identifier = 'L'")


def seed_track(track: DataFrame, storm_id: str, *, points: int = 21) -> DataFrame:
    """The first ``points`` synoptic positions of a storm, with hours from the first and wind in mph."""
    rows = track.where((F.col("storm_id") == storm_id) & (F.minute("ts") == 0) & F.hour("ts").isin(0, 6, 12, 18))
    first = rows.orderBy("ts").limit(points)
    w = Window.partitionBy("storm_id").orderBy("ts")
    hours = (F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(w))) / 3600
    return first.select("storm_id", "ts", "lat", "lon", hours.alias("hours_from_now"), F.bround(F.col("max_wind_kts") * F.lit(1.150779448), 1).alias("peak_wind"))


def parse_amo(lines: DataFrame) -> DataFrame:
    """(year, month, value) of three-column monthly lines; sentinels at or below -99 go."""
    c = F.split(F.trim("value"), "\\s+")
    rows = lines.select(F.get(c, F.lit(0)).try_cast("int").alias("year"), F.get(c, F.lit(1)).try_cast("int").alias("month"), F.get(c, F.lit(2)).try_cast("double").alias("value"))
    return rows.where("year BETWEEN 1800 AND 2200 AND month BETWEEN 1 AND 12 AND value > -99")


def parse_oni(lines: DataFrame) -> DataFrame:
    """(year, month, value) of lines with a year and twelve months; sentinels go."""
    c = F.split(F.trim("value"), "\\s+")
    rows = lines.where(F.size(c) >= 13).select(F.get(c, F.lit(0)).try_cast("int").alias("year"), F.posexplode(F.slice(c, 2, 12)).alias("i", "v"))
    return rows.select("year", (F.col("i") + 1).alias("month"), F.col("v").try_cast("double").alias("value")).where("year BETWEEN 1800 AND 2200 AND value > -99")


def parse_adeck(lines: DataFrame) -> DataFrame:
    """Ensemble members of an ATCF a-deck: (member, track ordered by lead hour), winds converted from knots to mph."""
    c = F.transform(F.split("value", ","), lambda x: F.trim(x))
    g = lambda i: F.get(c, F.lit(i))
    tenths = lambda x: coordinate(F.concat(F.regexp_replace(x, "[NSEW]$", ""), F.substring(x, -1, 1))) / 10
    rows = lines.where(g(4).rlike("^A[CP](0[0-9]|1[0-9]|20)$")).select(g(4).alias("member"), g(5).try_cast("int").alias("hours"), tenths(g(6)).alias("lat"), tenths(g(7)).alias("lon"), (g(8).try_cast("double") * 1.150779448).alias("wind_mph"))
    rows = rows.where("hours IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["member", "hours"])
    return rows.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("hours", "lat", "lon", "wind_mph"))).alias("track"))


def parse_forecast_errors(lines: DataFrame, hours: list[int]) -> DataFrame:
    """(year, hour, error) of forecast error lines behind a 'Date/Time' line; -9999 is missing.

    Columns: date, storm id, then one error per lead hour.
    """
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.col("value").startswith("Date/Time").cast("int")).over(w)
    c = F.split(F.trim("value"), "\\s+")
    rows = lines.withColumn("seen", seen).where((F.col("seen") == 1) & ~F.col("value").startswith("Date/Time") & (F.size(c) >= 2 + len(hours)))
    cells = F.arrays_zip(F.array(*map(F.lit, hours)).alias("hour"), F.slice(c, 3, len(hours)).alias("v"))
    rows = rows.select(F.substring(F.get(c, F.lit(1)), -4, 4).try_cast("int").alias("year"), F.explode(cells).alias("x"))
    return rows.select("year", F.col("x.hour").alias("hour"), F.col("x.v").try_cast("double").alias("error")).where("error IS NOT NULL AND error <> -9999")


def parse_fires(rows: DataFrame) -> DataFrame:
    """Fire detections of a CSV read with a header: brightness by whichever column there is, time from date and time."""
    bright = [F.col(c).try_cast("double") for c in ("bright_ti4", "brightness") if c in rows.columns]
    return rows.select(F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.coalesce(*bright).alias("brightness"), F.concat("acq_date", F.lit("T"), "acq_time", F.lit("Z")).alias("ts"))


def parse_declarations(rows: DataFrame) -> DataFrame:
    """One row per disaster: its first header and its counties, each once in order, without '(County)'."""
    county = F.trim(F.regexp_replace("county", "\\s*\\(County\\)", ""))
    listed = rows.groupBy("disaster").agg(F.min_by("title", "seq").alias("title"), F.array_sort(F.collect_list(F.struct("seq", county.alias("county")))).alias("l"))
    return listed.select("disaster", "title", F.array_distinct(F.transform("l", lambda x: x["county"])).alias("counties"))


ALERT = T.StructType([T.StructField("properties", T.StructType([T.StructField("event", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("areaDesc", T.StringType())])), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType())]))])


def parse_alerts(lines: DataFrame, events: list[str]) -> DataFrame:
    """(event, severity, area, geometry type) of alert features, one JSON object per line, of the events listed."""
    f = F.from_json("value", ALERT)
    rows = lines.select(f.alias("f")).select(F.col("f.properties.event").alias("event"), F.coalesce("f.properties.severity", F.lit("unknown")).alias("severity"), F.col("f.properties.areaDesc").alias("area"), F.when(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"), F.col("f.geometry.type")).alias("geometry"))
    return rows.where(F.col("event").isin(*events))


def elevation(payload) -> Column:
    """Metres from a service's answer: its sentinel and values outside -200 to 5000 are missing."""
    v = F.get_json_object(payload, "$.value").try_cast("double")
    return F.when((v != -1000000) & v.between(-200, 5000), v)


def write_long_losses(losses: DataFrame, path: str) -> None:
    """Loss artifact in long form, as Parquet with zstd."""
    losses.write.mode("overwrite").option("compression", "zstd").parquet(path)


def wide_losses(losses: DataFrame, draws: int) -> DataFrame:
    """The artifact's wide form: a column k0000, k0001, ... per draw; missing ones are 0."""
    names = [f"k{k:04d}" for k in range(draws)]
    wide = losses.withColumn("n", F.format_string("k%04d", F.col("k"))).groupBy(F.col("cohort_id").alias("cohort_key")).pivot("n", names).agg(F.first("loss"))
    return wide.na.fill(0.0, names)


def long_losses(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "cohort_key"]
    return wide.unpivot("cohort_key", names, "n", "loss").select(F.col("cohort_key").alias("cohort_id"), F.substring("n", 2, 10).cast("long").alias("k"), "loss")


def write_losses_json(losses: DataFrame, path: str, draws: int) -> None:
    """One JSON line per cohort with its first ``draws`` losses, rounded to cents."""
    listed = losses.groupBy("cohort_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", F.round("loss", 2).alias("loss")))), lambda x: x["loss"]), 1, draws).alias("losses"))
    listed.write.mode("overwrite").json(path)


#: Columns of a policy book's CSV.
BOOK_COLUMNS = ("policy_id", "state", "zip3", "lat", "lon", "tiv", "build_type", "flood_zone")
OPTIONAL_COLUMNS = ("county", "build_year", "elevation_m", "premium_annual", "cv_features")


def read_book_csv(spark: SparkSession, path: str) -> DataFrame:
    """A policy book as strings, quotes and line breaks inside quotes honoured; see operators.ingest.validate.

    Columns are bound by the header's names (blanks around them and a byte order mark go, case doesn't count), in any order; other columns are left out and
    optional ones that are absent are null.  A required column that is absent, or one that is there twice, is an error.  All files of a
    folder must have the header of the first: one with other columns fails when read.
    """
    how = dict(header=True, quote='"', escape='"', multiLine=True)
    first = spark.read.csv(path, **how)
    raw = spark.read.csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in first.columns]), enforceSchema=False, **how)
    place: dict[str, list[int]] = {}
    for i, c in enumerate(raw.columns):
        name = c.lstrip("\ufeff").strip().lower()
        if name.endswith(str(i)) and name.removesuffix(str(i)) in (*BOOK_COLUMNS, *OPTIONAL_COLUMNS):
            name = name.removesuffix(str(i))  # Spark puts their place behind names that are there twice
        place.setdefault(name, []).append(i)
    absent = [c for c in BOOK_COLUMNS if c not in place]
    twice = [c for c in (*BOOK_COLUMNS, *OPTIONAL_COLUMNS) if len(place.get(c, ())) > 1]
    if absent or twice:
        raise ValueError("; ".join(filter(None, (absent and f"columns absent: {', '.join(absent)}", twice and f"columns twice: {', '.join(twice)}"))))
    named = raw.toDF(*(f"c{i}" for i in range(len(raw.columns))))
    return named.select(*((F.col(f"c{place[c][0]}") if c in place else F.lit(None).cast("string")).alias(c) for c in (*BOOK_COLUMNS, *OPTIONAL_COLUMNS)))


def sim_files(spark: SparkSession, path: str) -> DataFrame:
    """(sim_id, file, bytes) of the loss files of a folder: their names without ``.parquet``, from file metadata alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("sim_id"), F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_sims(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Wide loss artifacts of a folder with their sim_id: of all files, or of the ``ids`` named (a file a sim); other files aren't opened.

    An id without a file has no rows (see ``missing_sims``); without any file the result has no loss columns.
    """
    listed = sim_files(spark, path)
    chosen = listed if ids is None else listed.where(F.col("sim_id").isin(*ids))
    files = [r["file"] for r in chosen.select("file").orderBy("file").collect()]
    if not files:
        return spark.createDataFrame([], "sim_id string, cohort_key string")
    return spark.read.option("mergeSchema", True).parquet(*files).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.parquet$", 1).alias("sim_id"), "*")


def missing_sims(known: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``known`` (sim_id) that have no file in the listing ``files`` (sim_id, ...)."""
    return known.join(files.select("sim_id"), "sim_id", "left_anti")


def write_claims_csv(claims: DataFrame, path: str) -> None:
    """Claims list as CSV: losses in whole dollars, nulls empty."""
    claims.select("id", "zip3", "cohort_id", "tiv", "severity", F.coalesce(F.format_string("%.0f", "expected_loss"), F.lit("")).alias("expected_loss")).write.mode("overwrite").csv(path, header=True, emptyValue="")


def _coordinate(number: str, text: str, negative: str) -> Column:
    """A decimal field, or else a text such as 28.5N; null if neither is a number."""
    found = F.regexp_extract(F.trim(text), r"(?i)^(-?[0-9]+(?:\.[0-9]+)?)\s*([NSEW])$", 1)
    side = F.upper(F.regexp_extract(F.trim(text), r"(?i)([NSEW])$", 1))
    signed = F.when(side == negative, -found.try_cast("double")).otherwise(found.try_cast("double"))
    return F.coalesce(F.col(number).try_cast("double"), F.when(found != "", signed), F.col(text).try_cast("double"))


def active_storms(lines: DataFrame) -> DataFrame:
    """Storms of a JSON line each (value): numbers may be texts, blanks are null; a storm without an id goes.

    Returns id (upper case), basin (its first two letters), name, classification, intensity_kt, pressure_mb, latitude, longitude, last_update.
    """
    fields = ["id", "name", "classification", "intensity", "pressure", "latitudeNumeric", "latitude", "longitudeNumeric", "longitude", "lastUpdate"]
    raw = lines.select(F.from_json("value", ", ".join(f"{f} string" for f in fields)).alias("j")).select("j.*").where("trim(id) <> ''")
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    key = F.upper(F.trim("id"))
    return raw.select(
        key.alias("id"), F.substring(key, 1, 2).alias("basin"), blank("name").alias("name"), F.upper(blank("classification")).alias("classification"), F.col("intensity").try_cast("double").alias("intensity_kt"), F.col("pressure").try_cast("double").alias("pressure_mb"),
        _coordinate("latitudeNumeric", "latitude", "S").alias("latitude"), _coordinate("longitudeNumeric", "longitude", "W").alias("longitude"), blank("lastUpdate").alias("last_update"),
    )


def read_storm_events(spark: SparkSession, path: str, states: list[str], kinds: list[str]) -> DataFrame:
    """Rows of gzipped or plain CSV event files (Latin-1, with a header) of some states and event types, once per EVENT_ID."""
    rows = spark.read.options(header=True, encoding="ISO-8859-1", multiLine=True, escape='"').csv(path)
    return rows.where(F.upper("STATE").isin(*(s.upper() for s in states)) & F.col("EVENT_TYPE").isin(*kinds) & F.col("EVENT_ID").isNotNull()).dropDuplicates(["EVENT_ID"])
