"""Append-only ledgers: first writes, upserts, queue folds and canonical digests.

No update or delete is offered; a lifecycle is a log of events, folded on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a queue entry becomes: (state, move) to state (fixed values).
MOVES = {("none", "enqueue"): "pending", ("pending", "claim"): "claimed", ("pending", "cancel"): "cancelled", ("claimed", "complete"): "completed", ("claimed", "fail"): "failed"}


def first_writes(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key: what an append that ignores known keys leaves."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*other), F.struct(*order)).alias("r")).select(key, "r.*")


def last_writes(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an upsert."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("r")).select(key, "r.*")


def insert_or_ignore(known: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """New rows only: one per key that ``known`` lacks."""
    return first_writes(rows.join(known.select(key), key, "left_anti"), key, *order)


def append(known: DataFrame, rows: DataFrame, key: str, path: str, *order: str) -> int:
    """Append the new rows to the ledger at ``path``; returns how many."""
    new = insert_or_ignore(known, rows, key, *order).select(*known.columns).persist()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def fold_queue(moves: DataFrame, fan_bits: int = 10) -> DataFrame:
    """(decision_id, state) after all of a decision's moves (decision_id, seq, move) in order of seq, then of move.

    A move that the current state doesn't allow changes nothing; nor does one that is unknown, repeated or without seq or decision.  Moves
    are maps of states, and maps compose associatively: runs of 2 ** ``fan_bits`` sequence numbers are composed first, then
    runs of such runs, so that one decision's moves are spread over tasks and no list is longer than a run (times the number of moves).
    """
    states = sorted({s for s, _ in MOVES} | set(MOVES.values()))
    at = {s: i for i, s in enumerate(states)}
    kinds = sorted({m for _, m in MOVES})
    maps = {m: [at[MOVES.get((s, m), s)] for s in states] for m in kinds}
    same = F.array(*(F.lit(i) for i in range(len(states))))
    own = F.lit(None).cast("array<int>")
    for m in kinds:
        own = F.when(F.col("move") == m, F.array(*map(F.lit, maps[m]))).otherwise(own)
    none = moves.select("decision_id").distinct()
    runs = moves.where(F.col("move").isin(kinds) & F.col("seq").isNotNull() & F.col("decision_id").isNotNull())
    runs = runs.select("decision_id", F.col("seq").cast("long").alias("run"), "move").distinct().withColumn("map", own)
    low, high = runs.agg(F.min("run"), F.max("run")).first()

    def composed(rows: DataFrame, *keys: str) -> DataFrame:
        log = F.array_sort(F.collect_list(F.struct("run", "move", "map")))
        return rows.groupBy(*keys).agg(log.alias("log")).select(*keys, F.aggregate("log", same, lambda acc, r: F.transform(acc, lambda s: F.get(r["map"], s))).alias("map"))

    while low is not None and high - low >= 1 << fan_bits:
        runs = composed(runs.withColumn("next", F.shiftright("run", fan_bits)), "decision_id", "next").select("decision_id", F.col("next").alias("run"), F.lit("").alias("move"), "map")
        low, high = low >> fan_bits, high >> fan_bits
    last = composed(runs, "decision_id").select("decision_id", F.get(F.array(*map(F.lit, states)), F.get("map", F.lit(at["none"]))).alias("state"))
    return none.join(last, "decision_id", "left").select("decision_id", F.coalesce("state", F.lit("none")).alias("state"))


def canonical(fields: dict) -> Column:
    """Canonical JSON of nested {name: column or dict}: sorted names, no white space."""
    def struct(f: dict) -> Column:
        return F.struct(*((struct(f[k]) if isinstance(f[k], dict) else F.col(f[k])).alias(k) for k in sorted(f)))

    return F.to_json(struct(fields), {"ignoreNullFields": "false"})


def canonical_digest(fields: dict) -> Column:
    return F.sha2(canonical(fields), 256)
