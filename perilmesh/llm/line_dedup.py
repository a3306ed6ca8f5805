"""Exact line dedup across documents with levelled sorted runs of line hashes.

An index of seen lines is a set of runs: bucketed tables sorted by line hash, no
hash in two of them.  A batch of documents is reduced to its line hashes, which
are merge-anti-joined with each run (both sides are hashed into the same buckets,
so a run is never shuffled or sorted again); what remains is fresh and becomes a
run of level 0.  When a level has ``fanout`` runs they are merged into one run of
the next level, so a batch meets a logarithmic number of runs.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Batches, cuts, free_names, fresh_path, named, staged

_WS = " \t\n\x0b\x0c\r"


def line_key(line: str, least: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key is shorter than ``least`` code points."""
    key = line.strip(_WS)
    return blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= least else None


def line_hashes(docs: DataFrame, *, least: int = 10) -> DataFrame:
    """(doc_id, h): the distinct hashes of each document's lines."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            ids, found = [], []
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                own = {k for line in (text or "").split("\n") if (k := line_key(line, least))} if i is not None else ()
                ids += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary")


class LineIndex:
    """Levelled sorted runs of (h, first): a line's hash and the document that keeps it."""

    def __init__(self, spark: SparkSession, *, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", fresh_path(self.spark, table)).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, h); returns the fresh (h, first) among its hashes.

        ``first`` is the smallest doc_id of the batch that has the line.
        """
        fresh = lines.groupBy("h").agg(F.min("doc_id").alias("first"))
        for run in self.runs:
            fresh = fresh.join(self.spark.table(run).select("h"), "h", "left_anti")
        self._write(fresh, 0)
        new = self.spark.table(self.levels[0][-1])
        return new

    def compact(self) -> None:
        """Merge each level that is full into one run of the next level."""
        for level in range(len(self.levels)):
            full = self.levels[level]
            if len(full) >= self.fanout:
                merged = self.spark.table(full[0])
                for run in full[1:]:
                    merged = merged.unionByName(self.spark.table(run))
                self._write(merged, level + 1)
                self.levels[level] = []
                for run in full:
                    self.spark.sql(f"DROP TABLE {run}")

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.levels = []


def dedup_lines(docs: DataFrame, *, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with each line kept only in the smallest doc_id that holds it.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased; keys of fewer than ``least`` code points are left alone, and
    repeats inside the keeping document stay.  All columns are returned, text
    being what is left, and n_lines and n_dropped (columns of these names in
    ``docs`` are replaced).  A null or empty text is one empty line.  Rows that
    share a doc_id are one document; rows without a doc_id are left as they are.
    ``batches`` is the number of doc_id ranges that go into the index one by one.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    lines = staged(line_hashes(docs, least=least), "lines")
    bounds = [None, *cuts(docs, "doc_id", batches), None]
    index, dropped = LineIndex(spark, fanout=fanout), None
    try:
        for low, high in zip(bounds, bounds[1:]):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("doc_id") > low)
            if high is not None:
                batch = batch.where(F.col("doc_id") <= high)
            fresh = index.add(batch)
            lost = staged(batch.join(fresh.select("h", F.col("first").alias("doc_id")), ["h", "doc_id"], "left_anti"), "lost")
            dropped = lost if dropped is None else dropped.unionByName(lost)
            index.compact()
    finally:
        index.drop()
    (gone_name,) = free_names(docs, "_lost")
    lost = dropped.groupBy("doc_id").agg(F.collect_set("h").alias(gone_name))
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # Arrow maps don't take names with dots
    joined = docs.join(lost, "doc_id", "left").select(*(c.alias(n) for c, n in zip(named([*docs.columns, gone_name]), [*plain.values(), "gone"])))
    out = StructType([*(StructField(plain[f.name], f.dataType) for f in docs.schema.fields), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    own_text = plain["text"]

    def cut(batches: Batches) -> Batches:
        for b in batches:
            texts, counts, drops = [], [], []
            for text, gone in zip(b[own_text].to_pylist(), b["gone"].to_pylist()):
                parts = (text or "").split("\n")
                counts.append(len(parts))
                if gone:
                    gone = set(gone)
                    parts = [p for p in parts if line_key(p, least) not in gone]
                drops.append(counts[-1] - len(parts))
                texts.append("\n".join(parts) if gone else text)
            names = [n for n in b.schema.names if n != "gone"]
            columns = [pa.array(texts, b.schema.field(n).type) if n == own_text else b[n] for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, out).select(*(F.col(n).alias(c) for c, n in plain.items()), "n_lines", "n_dropped")
