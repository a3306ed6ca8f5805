"""Ingest of policy books: row validation, column mapping, names that stand for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X

#: The book's fields with the column names they go by (fixed values).
FIELDS = {
    "policy_id": ["policy_id", "policyid", "policy", "id", "pol_id"],
    "state": ["state", "st", "province"],
    "zip3": ["zip3", "zip_3", "zip", "postal"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "long", "longitude"],
    "tiv": ["tiv", "total_insured_value", "insured_value", "value"],
    "build_type": ["build_type", "buildtype", "construction", "build"],
    "flood_zone": ["flood_zone", "floodzone", "flood", "fema_zone", "zone"],
    "county": ["county"],
    "build_year": ["build_year", "buildyear", "year_built", "yob"],
    "elevation_m": ["elevation_m", "elevation", "elev"],
    "premium_annual": ["premium_annual", "premium", "annual_premium"],
}


def validate(raw: DataFrame) -> DataFrame:
    """``raw`` string columns with normalised zip3, state, build_type, flood_zone, and the first failed check as ``error``.

    Nothing is dropped: rows without an error are those where ``error`` is null.
    """
    zip3 = F.lpad(F.substring("zip3", 1, 3), 3, "0")
    number = lambda c: F.col(c).try_cast("double")
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks: list[tuple[Column, str]] = [
        (number("policy_id").isNull(), "policy_id is not a number"),
        (missing("lat") | missing("lon"), "lat or lon is missing"),
        (~F.coalesce(number("lat").between(-90, 90) & number("lon").between(-180, 180), F.lit(False)), "lat or lon is out of range"),
        (~F.coalesce(number("tiv") > 0, F.lit(False)), "tiv is not positive"),
        (~F.coalesce(F.col("state").rlike("^[A-Z]{2}$"), F.lit(False)), "state is not two letters"),
        (~F.coalesce(F.col("zip3").rlike("^[0-9]{3}$"), F.lit(False)), "zip3 is not three digits"),
        (~F.coalesce(F.col("build_type").isin("wood_frame", "masonry", "manufactured"), F.lit(False)), "build_type is unknown"),
        (~F.coalesce(F.col("flood_zone").isin("X", "A", "AE", "VE"), F.lit(False)), "flood_zone is unknown"),
    ]
    rows = raw.withColumns({"zip3": zip3, "state": F.upper(F.trim("state")), "build_type": F.lower(F.trim("build_type")), "flood_zone": F.upper(F.trim("flood_zone"))})
    error = F.when(*[checks[0][0], F.lit(checks[0][1])])
    for failed, message in checks[1:]:
        error = error.when(failed, F.lit(message))
    return rows.withColumn("error", error)


def name_tokens(name) -> Column:
    """Lower-case words of a column name: camel case and delimiters split it, digits at the end of a word go."""
    spaced = F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))
    words = F.filter(F.split(spaced, "[\\s_\\-./]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.when(w.rlike("^(st|addressline|address)[0-9]$"), w).otherwise(F.regexp_replace(w, "[0-9]+$", "")))
    return F.filter(bare, lambda w: w != "")


def classify_columns(names: DataFrame) -> DataFrame:
    """(name, is_pii, matched_token, category, allowed_by) of each column name.

    The first word that stands for personal data decides, unless any word makes the name harmless.
    """
    kinds = F.create_map(*(F.lit(x) for kind, words in X.PII.items() for w in words for x in (w, kind)))
    allowed = F.array(*map(F.lit, X.PII_ALLOWED))
    rows = names.withColumn("tokens", name_tokens("name"))
    matched = F.get(F.filter("tokens", lambda w: F.map_contains_key(kinds, w)), F.lit(0))
    rows = rows.withColumn("matched_token", matched).withColumn("category", F.try_element_at(kinds, F.coalesce("matched_token", F.lit(""))))
    rows = rows.withColumn("allowed_by", F.when(F.col("matched_token").isNotNull(), F.get(F.filter("tokens", lambda w: F.array_contains(allowed, w)), F.lit(0))))
    return rows.select("name", (F.col("matched_token").isNotNull() & F.col("allowed_by").isNull()).alias("is_pii"), "matched_token", "category", "allowed_by")


def suggest_mapping(names: DataFrame) -> DataFrame:
    """(field, name): the best column for each field of the book; null where none resembles it.

    100 for equal names, 80 if an alias is a word of the name, 60 if the name is a word of an
    alias, 20 if one (of 3 letters or more) is inside the other.  Each column serves one field, the one
    with the highest score (ties in field order); names of personal data are left out.
    """
    spark = names.sparkSession
    fields = spark.createDataFrame([(i, f, a) for i, (f, al) in enumerate(FIELDS.items()) for a in al], "ord int, field string, alias string")
    bare = lambda c: F.regexp_replace(F.lower(c), "[\\s_-]", "")
    words = lambda c: F.split(F.lower(c), "[\\s_\\-./]+")
    own = classify_columns(names).where("NOT is_pii").select("name").withColumn("pos", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    pairs = own.join(F.broadcast(fields), F.lit(True))
    n, a = bare("name"), bare("alias")
    score = (
        F.when(n == a, 100).when(F.array_contains(words("name"), F.lower("alias")), 80).when(F.array_contains(words("alias"), F.lower("name")), 60)
        .when((F.length(a) >= 3) & F.contains(n, a) | (F.length(n) >= 3) & F.contains(a, n), 20).otherwise(0)
    )
    scored = pairs.withColumn("score", score).groupBy("ord", "field", "name", "pos").agg(F.max("score").alias("score")).where("score > 0")
    by_column = scored.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "ord"))).where("r = 1")
    by_field = by_column.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("score"), "pos"))).where("r = 1")
    return fields.select("ord", "field").distinct().join(by_field.select("field", "name", "score"), "field", "left").orderBy("ord").select("field", "name", "score")


def mapped(rows: DataFrame, mapping: dict[str, str], *, refused: list[str], file: str, at: str, index: str) -> DataFrame:
    """Columns of ``rows`` renamed by ``mapping`` (field to column), and the lineage of each as JSON.

    src_row is the number of the row in its file: ``index`` (from 0) and the header line before it.
    """
    source = F.struct(F.lit(file).alias("src_file"), (F.col(index) + 2).alias("src_row"), F.lit(at).alias("mapped_at"), F.array_sort(F.array(*map(F.lit, refused))).alias("refused_columns"))
    return rows.select(*(F.col("`" + c + "`").alias(f) for f, c in mapping.items()), F.to_json(source).alias("lineage"))
