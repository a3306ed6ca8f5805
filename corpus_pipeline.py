"""From raw documents to a training mix: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
A document is dropped by a stage only for that stage's own reason:

1. toxicity: the machine, trained on labels that aren't held out, scores 0.3 or more;
2. line_dedup: lines that a smaller doc_id has go; a document with nothing left but blanks goes with them;
3. simhash_near_dedup: of documents linked by near-equal fingerprints, or by 0.8 of their five-word
   shingles, the smallest doc_id stays;
4. decontamination: a twentieth or more of the words are in windows of benchmark items;
5. mixing: documents are repeated by the rate of their source (copy is 1, 2, ...).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilmesh.llm.common import documents, staged
from perilmesh.llm.decontaminate import contamination
from perilmesh.llm.line_dedup import dedup_lines
from perilmesh.llm.mixing import mix, repeated
from perilmesh.llm.simhash import near_duplicates
from perilmesh.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("toxic_predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & F.col("text").rlike(r"\A[\x20\x09-\x0D]*\z")
    return kept.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = near_duplicates(docs, similarity=0.8).where("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated(mix(docs.select(*COLUMNS))).select(*COLUMNS, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Toxicity's machine and SimHash's words have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
