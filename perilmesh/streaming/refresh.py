"""Structured Streaming forms of the feed jobs: change detection, snapshots and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import insert_or_ignore


def changed(advisories: DataFrame) -> DataFrame:
    """(storm_id, advisory, ts) where a storm's advisory differs from the last one seen.

    State is one advisory and time per storm, kept by the state store, so that it survives restarts.
    Rows that come late (older than the state) change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, pd.Timestamp.min.value)
        rows = pd.concat(list(frames)).sort_values(["ts", "advisory"])
        out = []
        for advisory, ts in zip(rows["advisory"], rows["ts"]):
            if ts.value >= at:
                if advisory != last:
                    out.append((key[0], advisory, ts))
                last, at = advisory, ts.value
        state.update((last, at))
        yield pd.DataFrame(out, columns=["storm_id", "advisory", "ts"])

    schema = "storm_id string, advisory string, ts timestamp"
    return advisories.groupBy("storm_id").applyInPandasWithState(step, schema, "advisory string, at long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events per type and tumbling window; rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n")


def append_ledger(rows: DataFrame, path: str, checkpoint: str, key: str, *order: str) -> StreamingQuery:
    """Each micro-batch's new keys go to the Parquet ledger at ``path``; replays add nothing."""
    schema = rows.schema

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(schema).parquet(path)
        except Exception as missing:  # the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            known = batch.limit(0)
        new = insert_or_ignore(known, batch, key, *order).select(*schema.names)
        new.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(rows: DataFrame, job: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Run ``job`` on every micro-batch that there is now, then stop: a scheduled refresh."""
    return rows.writeStream.foreachBatch(lambda batch, _: job(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
