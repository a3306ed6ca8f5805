"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, held_out, staged
from .oracles import ORACLES


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_of, read_archives, write_archives

    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("payload", F.col("html")), path)
    records = read_archives(spark, path, payloads=False).where("gap_reason IS NULL")
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_profiles, identify

    docs = documents(spark, sf_dir)
    found = identify(docs, fit_profiles(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), proximity=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, size_in_words

    sizes = staged(documents(spark, sf_dir).select("doc_id", "source", size_in_words(F.col("text")).alias("size")), "sizes")
    mixed = mix(sizes, size="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .version_sketch import versions

    return versions(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_quality, score_quality

    docs, unseen = documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=unseen))
    return scored.select("doc_id", unseen.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node", "parent")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SENT: set[str] = set()


def _send_package(spark: SparkSession) -> None:
    """Send this package to all Python workers, once per application, as ``spark-submit --py-files`` does.

    Not done where it is installed or sent already in that way (``spark.submit.pyFiles``).
    """
    context = spark.sparkContext
    if context.applicationId in _SENT or "perilmesh" in (spark.conf.get("spark.submit.pyFiles", "") or ""):
        return
    _SENT.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='perilmesh-')}/perilmesh.zip"  # the driver serves it to executors from there
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)


def _with_workers(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _send_package(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _with_workers(f) for f in (op1_warc_round_trip, op2_token_counts, op3_language_id, op4_decontaminate, op5_mix_sources, op6_version_sketch, op7_simhash, op8_license_scan, op9_line_dedup, op10_toxicity, op11_quality_rules, op12_prefix_trie, op13_ranked_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
