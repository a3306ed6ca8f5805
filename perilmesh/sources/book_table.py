"""A policy book that is replaced and updated as a whole: versions of hash buckets, named by a manifest.

Rows live in folders of buckets of the id's hash.  A change writes new folders for the buckets that it touches, then a manifest that
names each bucket's folder; the manifest's file is renamed into place last.  So a reader sees the book before or after a change, never
between, and a load that fails leaves the old book.  Old folders stay readable until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "_bucket"


class BookTable:
    def __init__(self, spark: SparkSession, path: str, *, key: str = "id", buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where, fs = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (DDL) and the folder of each bucket; of an unwritten table version 0 without folders."""
        version = version if version is not None else max(self._versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _commit(self, before: dict, schema: str, folders: dict) -> int:
        """Put the next manifest in place; fails if another writer has put one there meanwhile."""
        version = before["version"] + 1
        temporary, fs = self._fs(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "folders": folders}).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/manifests/{version:012d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another load")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The book as of a version (the last one)."""
        return self._of(self.manifest(version))

    def _of(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in manifest["folders"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"] or f"{self.key} long")
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by bucket; the folders by bucket."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        held = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))
        held.repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        where, fs = self._fs(folder)
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found if n.startswith(_BUCKET)}

    def replace(self, rows: DataFrame) -> int:
        """The book becomes ``rows``; returns the new version.  Rows without a key, or with one twice, are an error and nothing changes."""
        before = self.manifest()
        folders = self._write(rows)
        now = {"version": -1, "schema": _ddl(rows), "folders": folders}
        keys = self._of(now).agg(F.count("*").alias("n"), F.count(self.key).alias("named")).first()
        twice = self._of(now).groupBy(self.key).count().where("count > 1").limit(1).collect()
        if keys["n"] != keys["named"] or twice:
            raise ValueError(f"rows without {self.key}, or the same one twice")
        return self._commit(before, now["schema"], folders)

    def update(self, changes: DataFrame, *, order: str | None = None) -> int:
        """Set the columns of ``changes`` (key and columns of the book) where they aren't null; returns the new version.

        Keys that the book lacks are left out.  Of several changes of a key the last by ``order`` counts, column by column.  Only
        the buckets that hold a changed key are read and written.
        """
        before = self.manifest()
        names = [c for c in changes.columns if c not in (self.key, order)]
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)
        changes = changes.groupBy(self.key).agg(*(last(c).alias(f"_new_{c}") for c in names))
        if not order and changes.count() == 0:
            return before["version"]
        touched = [r[0] for r in changes.select(F.pmod(F.xxhash64(F.col(self.key).cast("long")), F.lit(self.buckets))).distinct().collect()]
        held = self._of(before, touched)
        new = held.join(changes, self.key, "left").select(*(F.coalesce(f"_new_{c}", c).cast(held.schema[c].dataType).alias(c) if c in names else F.col(c) for c in held.columns))
        return self._commit(before, before["schema"], before["folders"] | self._write(new))

    def vacuum(self) -> None:
        """Delete the data folders and manifests that the last version doesn't name; no reader of an older version may be left."""
        now = self.manifest()
        kept = {p.rsplit("/", 2)[1] for p in now["folders"].values()}
        where, fs = self._fs(f"{self.path}/data")
        for s in fs.listStatus(where) if fs.exists(where) else []:
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)
        for v in self._versions()[:-1]:
            fs.delete(self._fs(f"{self.path}/manifests/{v:012d}.json")[0], False)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
