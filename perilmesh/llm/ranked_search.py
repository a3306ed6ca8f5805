"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists.

The index of the documents has two forms, both bucketed by a row key so that they join without a shuffle:

* lists: (term, impact, row) by falling impact, cut into bands of growing depth (a band is a
  partition of the table, so a round reads its own band only);
* the forward index: a row's terms, impacts and bands.

All items are searched together.  Round r is a turn of sorted access: the next band of every list of the items still
open.  Each row met is looked up in the forward index (random access), which gives its full scores for
the items that met it for the first time.  An item's threshold is the score that a row not met so far
could have at most, from the highest impacts left in its lists; the item is closed when
the threshold falls strictly below its k-th score, so rows of equal score are all met, or when its lists are read to their ends.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, binary, fresh_path, staged
from .decontaminate import words_of

#: About so many (item, term) pairs make a block of items that is searched at once: what the driver and each task hold.
BLOCK_PAIRS = 400_000
#: Rows of lists in a term's first band; each further band ends at GROWTH times the depth.
FIRST, GROWTH = 1024, 4
#: Impacts are below 1,000,000; bands are cut between multiples of this.
STEP = 1024
_CELLS, _EXPANDED = 1 << 21, 1 << 20


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times); rows that share an item_id are one item, null texts have no terms."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            ids, terms, times = [], [], []
            for i, text in zip(b["item_id"].to_pylist(), binary(b["text"])):
                for term, n in Counter(words_of(text)).items():
                    ids.append(i)
                    terms.append(term.decode())
                    times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item_id", "term", "times"])

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term string, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(h, doc_id, n, terms, times) of each row with at least one term: n terms in all, and those of the vocabulary by their places in it."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): k for k, t in enumerate(vocabulary)})

    def run(batches: Batches) -> Batches:
        known = sent.value
        for b in batches:
            kept, sizes, terms, times = [], [], [], []
            for k, text in enumerate(binary(b["text"])):
                words = words_of(text)
                if words:
                    own = [(known[w], n) for w, n in Counter(words).items() if w in known]
                    kept.append(k)
                    sizes.append(len(words))
                    terms.append([t for t, _ in own])
                    times.append([n for _, n in own])
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b["h"].take(at), b["doc_id"].take(at), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["h", "doc_id", "n", "terms", "times"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(run, "h long, doc_id long, n long, terms array<int>, times array<long>")


def impact(times, n, n_docs: int, n_terms: int):
    """A term's impact without its weight, in 64-bit integers; for columns and numbers alike."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


@dataclass
class Index:
    """Lists and forward index of one vocabulary."""

    spark: SparkSession
    name: str
    weights: np.ndarray  # by term; 0 for terms that no row has
    rest: np.ndarray  # by term and band: the highest impact below the band, 0 if none

    @property
    def bands(self) -> int:
        return self.rest.shape[1]

    def band(self, r: int) -> DataFrame:
        return self.spark.table(f"{self.name}_lists").where(F.col("band") == r)

    def forward(self) -> DataFrame:
        return self.spark.table(f"{self.name}_forward")

    def drop(self) -> None:
        for kind in ("lists", "forward"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")


def build_index(docs: DataFrame, vocabulary: list[str], *, first: int = FIRST, growth: int = GROWTH, buckets: int | None = None) -> Index:
    """Index all rows of ``docs`` (doc_id, text) for the terms of ``vocabulary``."""
    spark = docs.sparkSession
    counted = staged(term_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    floor = np.full((len(vocabulary), 1), 0, np.int64)
    if not n_docs:
        return Index(spark, "", np.zeros(len(vocabulary), np.int64), floor)
    m = 75 + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    each = counted.select(m.alias("m"), F.explode(F.arrays_zip("terms", "times")).alias("e")).select(F.col("e.terms").alias("term"), F.expr("(1000000000L * e.times) div (1000 * e.times + 12 * m)").alias("g"))
    # a term's impacts are counted by steps (a thousand rows a term at most), and the steps dealt to bands by the depth at which they begin
    steps = each.groupBy("term", F.expr(f"g div {STEP}").alias("step")).agg(F.count("*").alias("rows"), F.max("g").alias("top"))
    down = Window.partitionBy("term").orderBy(F.col("step").desc())
    begins = steps.withColumn("above", F.sum("rows").over(down) - F.col("rows"))
    at = F.when(F.col("above") < first, 0).otherwise(F.floor(F.log(float(growth), F.greatest(F.col("above"), F.lit(1)) / F.lit(float(first)))) + 1).cast("int")
    edges = begins.groupBy("term", at.alias("band")).agg(F.min("step").alias("low"), F.max("top").alias("top"), F.sum("rows").alias("rows")).collect()
    n_bands = max((r["band"] for r in edges), default=0) + 1
    low, top, df = np.zeros((len(vocabulary), n_bands), np.int64), np.zeros((len(vocabulary), n_bands + 1), np.int64), np.zeros(len(vocabulary), np.int64)
    low[:] = 1 << 40
    for r in edges:
        low[r["term"], r["band"]] = r["low"] * STEP
        top[r["term"], r["band"]] = r["top"]
        df[r["term"]] += r["rows"]
    low = np.minimum.accumulate(low, axis=1)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    rest = np.maximum.accumulate(top[:, ::-1], axis=1)[:, ::-1][:, 1:]
    sent = spark.sparkContext.broadcast((weights > 0, low))

    def run(batches: Batches) -> Batches:
        weighty, lows = sent.value
        for b in batches:
            lists = b["terms"]
            size, term, times = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), b["times"].flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)
            kept = weighty[term] if len(term) else np.zeros(0, bool)
            row, term, times = row[kept], term[kept], times[kept].astype(np.int64)
            g = impact(times, b["n"].to_numpy()[row], n_docs, n_terms)
            band = (g[:, None] < lows[term]).sum(axis=1, dtype=np.int8)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))), pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((term, pa.int32()), (g, pa.int32()), (band, pa.int8()))]
            yield pa.RecordBatch.from_arrays([b["h"], b["doc_id"], *made], ["h", "doc_id", "terms", "impacts", "bands"])

    name, buckets = f"search_{uuid.uuid4().hex}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def table(df: DataFrame, kind: str, sort: list[str], by: list[str]) -> None:
        write = df.repartition(buckets, "h").write.bucketBy(buckets, "h").sortBy(*sort)
        (write.partitionBy(*by) if by else write).format("parquet").option("path", fresh_path(spark, f"{name}-{kind}")).saveAsTable(f"{name}_{kind}")

    table(counted.mapInArrow(run, "h long, doc_id long, terms array<int>, impacts array<int>, bands array<byte>"), "forward", ["h"], [])
    entries = spark.table(f"{name}_forward").select("h", F.explode(F.arrays_zip("terms", "impacts", "bands")).alias("e"))
    table(entries.select("h", F.col("e.terms").alias("term"), (-F.col("e.impacts")).alias("fall"), F.col("e.bands").alias("band")), "lists", ["term", "fall"], ["band"])
    return Index(spark, name, weights, rest)


@dataclass
class _Round:
    """What a task needs to score rows for the items that are open: their terms' (item, weight) lists, and scores to beat."""

    number: int
    k: int
    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    beat: np.ndarray

    def chunks(self, size: np.ndarray, term: np.ndarray):
        """Ranges of rows that expand to bounded arrays."""
        pairs = np.concatenate(([0], np.cumsum((self.starts[term + 1] - self.starts[term]))))
        ends = np.concatenate(([0], np.cumsum(size)))
        at, most = 0, max(1, _CELLS // max(1, len(self.beat)))
        while at < len(size):
            end = min(int(np.searchsorted(pairs[ends], pairs[ends[at]] + _EXPANDED, side="right")) - 1, at + most, len(size))
            yield at, (at := max(end, at + 1)), ends

    def scored(self, row: np.ndarray, n_rows: int, term: np.ndarray, impacts: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of the rows that an item meets in this round for the first time."""
        times = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(np.arange(len(term)), times)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times) + self.starts[term][entry]
        n_items = len(self.beat)
        cell, band = row[entry] * n_items + self.item[at], bands[entry]
        met = np.zeros(n_rows * n_items, bool)
        met[cell[band == self.number]] = True
        met[cell[band < self.number]] = False
        # sums are below 2 ** 53, where doubles are exact
        score = np.bincount(cell, weights=(impacts[entry] * self.weight[at]).astype(float), minlength=len(met)).astype(np.int64)
        found = np.flatnonzero(met)
        own = found % n_items
        good = (score[found] > 0) & (score[found] >= self.beat[own])
        return found[good] // n_items, own[good], score[found[good]]

    def best(self, batches: Batches) -> Batches:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for b in batches:
            size, term = np.diff(b["terms"].offsets.to_numpy()), b["terms"].flatten().to_numpy(zero_copy_only=False)
            impacts, bands = b["impacts"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), b["bands"].flatten().to_numpy(zero_copy_only=False)
            unnamed = b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            doc = b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            for low, high, ends in self.chunks(size, term):
                own = slice(ends[low], ends[high])
                row, item, score = self.scored(np.repeat(np.arange(high - low), size[low:high]), high - low, term[own], impacts[own], bands[own])
                held = self.top(*(np.concatenate(x) for x in zip(held, (item, score, doc[low:high][row], unnamed[low:high][row]))))
        item, score, doc, unnamed = held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=unnamed), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    def top(self, item, score, doc, unnamed):
        """The k best of each item; raises what others have to beat."""
        order = np.lexsort((doc, unnamed, -score, item))
        item, score, doc, unnamed = item[order], score[order], doc[order], unnamed[order]
        first = np.searchsorted(item, np.arange(len(self.beat)))
        rank = np.arange(len(item)) - first[item]
        kth = rank == self.k - 1
        self.beat[item[kth]] = np.maximum(self.beat[item[kth]], score[kth])
        kept = rank < self.k
        return item[kept], score[kept], doc[kept], unnamed[kept]


def search_block(docs: DataFrame, wanted: list[dict[str, int]], *, k: int = 20, **how) -> DataFrame:
    """(item, doc_id, score): the k best rows for each of ``wanted`` (term to times); item is its place."""
    vocabulary = sorted(set().union(*wanted))
    place = {t: n for n, t in enumerate(vocabulary)}
    index = build_index(docs, vocabulary, **how)
    spark = docs.sparkSession
    best = spark.createDataFrame([], "item long, doc_id long, score long")
    terms = [np.array([place[t] for t in w], np.int64) for w in wanted]
    weights = [np.array(list(w.values()), np.int64) * index.weights[t] for w, t in zip(wanted, terms)]
    live = [i for i, w in enumerate(weights) if w.any()]
    kth = np.zeros(len(wanted), np.int64)
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    try:
        for r in range(index.bands):
            if not live:
                break
            by_term: dict[int, list] = defaultdict(list)
            for i in live:
                for t, w in zip(terms[i].tolist(), weights[i].tolist()):
                    if w:
                        by_term[t].append((i, w))
            counts = np.zeros(len(vocabulary) + 1, np.int64)
            counts[[t + 1 for t in by_term]] = [len(v) for v in by_term.values()]
            flat = [p for t in sorted(by_term) for p in by_term[t]]
            turn = _Round(r, k, np.cumsum(counts), np.array([i for i, _ in flat], np.int64), np.array([w for _, w in flat], np.int64), kth.copy())
            sent = spark.sparkContext.broadcast(turn)
            # sorted access: the next band of the open lists (their terms are no more than a block has)
            lists = index.band(r).join(F.broadcast(spark.createDataFrame([(t,) for t in by_term], "term int")), "term", "left_semi")
            # random access: the rows met there, in the forward index; both are in the same buckets
            looked = index.forward().join(lists.select("h"), "h", "left_semi")
            found = looked.mapInArrow(lambda batches, sent=sent: sent.value.best(batches), "item long, doc_id long, score long")
            best = staged(best.unionByName(found).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).drop("place"), "best")
            full = {x["item"]: x["kth"] for x in best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("kth")).collect() if x["n"] >= k}
            for i, s in full.items():
                kth[i] = s
            left = {i: int((weights[i] * index.rest[terms[i], r]).sum()) for i in live}
            live = [i for i in live if left[i] and not (i in full and left[i] < full[i])]
    finally:
        if index.name:
            index.drop()
    return best


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, block_pairs: int = BLOCK_PAIRS, **how) -> DataFrame:
    """The k best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank (from 1), doc_id, score.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) for N rows with a term, df with this one; a row scores the sum of
    weight * ``impact`` over the item's terms, repeats included; scores of 0 aren't listed.  Equal scores are in order of doc_id,
    null last.  Each row of ``docs`` is a document, so rows that share a doc_id are ranked each; null
    texts and texts without terms aren't counted.  Rows that share an item_id (or have none) are one item.  Empty
    tables give no rows.  Items are searched in blocks of about ``block_pairs`` (item, term) pairs, so any number of them is.
    """
    spark = docs.sparkSession
    pairs = staged(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n in range(blocks):
        wanted: dict[int | None, dict[str, int]] = defaultdict(dict)
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).toLocalIterator():
            wanted[r["item_id"]][r["term"]] = r["times"]
        if not wanted:
            continue
        ids = sorted(wanted, key=lambda i: (i is None, i or 0))
        found = search_block(docs, [wanted[i] for i in ids], k=k, **how)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())).alias("rank")
        named = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        out = out.unionByName(found.select("item", rank, "doc_id", "score").join(named, "item").select("item_id", "rank", "doc_id", "score"))
    return out
