"""Helpers that the text operators share: shared folders, staging and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, every other byte itself.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` where the session has one.  Only where it is unset and
    Spark runs on this machine alone is a temporary folder made and set; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="perilmesh-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever characters these have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage, and what was computed survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a copy into Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def small_rows(df: DataFrame, most_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``most_rows`` of them, else None.

    The caller must have another way for None: this is the size check before
    anything is sent to all executors.
    """
    rows = df.limit(most_rows + 1).collect()
    return rows if len(rows) <= most_rows else None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id="doc_id"):
    """True for documents that are kept from all training: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 rising values that cut an integer column into ranges of like size; none of an empty table."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(map(int, found or [])))


Batches = Iterator[pa.RecordBatch]
