"""Benchmark decontamination over a distributed positional inverted index.

The test side decides what is looked up: every window of a benchmark item is
found by its two rarest words, counted over all documents.  The training side
stores positional postings (word, document, position) of those words.  Offset-adjusted lists
(document position less item position) of the rarest words are intersected first; where both words of a window
meet at an offset, the document's postings along the item are intersected with the lists of all
its other words, and runs of neighbouring positions as long as a window are exact phrase
matches.  Proximity matches come from the same index: both rarest words of a window, in any
order, fewer words apart than a window has.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, binary, small_rows, staged

#: Bytes of words: digits, a-z and all of non-ASCII; A-Z become a-z, the rest separates.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Up to so many words are sent to all tasks to select what is counted and posted; beyond, joins select.
MOST_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def _selected(words: DataFrame):
    """The distinct words as a broadcast set, or None if they are too many."""
    rows = small_rows(words, MOST_WORDS)
    return None if rows is None else words.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in rows))


def passages(items: DataFrame) -> DataFrame:
    """(item_id as string, words joined by spaces) of the distinct texts of items that have words."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["item_id"], pa.array([b" ".join(words_of(t)).decode() for t in binary(b["text"])], pa.string())], ["item_id", "passage"])

    found = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, passage string")
    return found.where("passage <> '' AND item_id IS NOT NULL").distinct()


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often each of ``words`` is in all texts, if at all."""
    wanted = _selected(words)

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for text in binary(b["text"]):
                own = words_of(text)
                counts.update(own if wanted is None else filter(wanted.value.__contains__, own))
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).join(words, "word", "left_semi")


def rare_words(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(passage_id, pos, other) of the two rarest words of each window that the documents may have; other is null for one word."""
    each = items.select("passage_id", F.posexplode(F.split("passage", " ")).alias("pos", "word")).join(counts, "word", "left")
    listed = each.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("words"))
    schema = pa.schema([("passage_id", pa.int64()), ("pos", pa.int64()), ("word", pa.string()), ("other_pos", pa.int64()), ("other", pa.string())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for key, words in zip(b["passage_id"].to_pylist(), b["words"].to_pylist()):
                n, chosen = [w["n"] for w in words], set()
                for i in range(max(1, len(n) - window + 1)):
                    rarest = sorted(range(i, min(len(n), i + window)), key=lambda p: (n[p], p))[:2]
                    if n[rarest[0]]:
                        chosen.add(tuple(rarest))
                out += [(key, p[0], words[p[0]]["word"], p[1] if len(p) > 1 else None, words[p[1]]["word"] if len(p) > 1 else None) for p in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * 5, schema)], schema=schema)

    return listed.mapInArrow(run, "passage_id long, pos long, word string, other_pos long, other string")


def postings(docs: DataFrame, words: DataFrame, *, ranges: str | None = None) -> DataFrame:
    """The positional index: (word, doc_id, h, pos), and a row without word for each document, pos being its number of words.

    h is the text's hash, which keeps rows of one doc_id apart.  ``ranges`` names a column of arrays of (low, high): then only
    positions in one of them are posted.
    """
    wanted = _selected(words)

    def run(batches: Batches) -> Batches:
        for b in batches:
            word, doc, text_hash, pos = [], [], [], []
            limits = b["ranges"].to_pylist() if ranges else [None] * b.num_rows
            for i, h, text, own_ranges in zip(b["doc_id"].to_pylist(), b["h"].to_pylist(), binary(b["text"]), limits):
                own = words_of(text)
                places = range(len(own)) if own_ranges is None else sorted({p for r in own_ranges for p in range(max(0, r["low"]), min(len(own), r["high"] + 1))})
                found = [p for p in places if wanted is None or own[p] in wanted.value]
                word += [None, *(own[p].decode() for p in found)]
                pos += [len(own), *found]
                doc += [i] * (len(found) + 1)
                text_hash += [h] * (len(found) + 1)
                if len(word) > 100_000:
                    yield _columns(word, doc, text_hash, pos)
                    word, doc, text_hash, pos = [], [], [], []
            yield _columns(word, doc, text_hash, pos)

    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", *([F.col(ranges).alias("ranges")] if ranges else []))
    return own.mapInArrow(run, "word string, doc_id long, h long, pos long")


def _columns(word, doc, text_hash, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), *(pa.array(x, pa.int64()) for x in (doc, text_hash, pos))], ["word", "doc_id", "h", "pos"])


def phrase_matches(docs: DataFrame, index: DataFrame, items: DataFrame, rare: DataFrame, window: int) -> DataFrame:
    """Exact matches: (doc_id, item_id, low, high), document words low to high being in windows of the item."""
    sought = rare.select(F.explode(F.array(F.struct("word", "pos"), F.struct(F.col("other").alias("word"), F.col("other_pos").alias("pos")))).alias("w"), "passage_id")
    sought = sought.select("passage_id", "w.word", F.col("w.pos").alias("item_pos")).where("word IS NOT NULL").distinct()
    listed = index.where("word IS NOT NULL").join(sought, "word").select("doc_id", "h", "passage_id", (F.col("pos") - F.col("item_pos")).alias("offset"), "item_pos")
    length = F.size(F.split("passage", " "))
    met = listed.groupBy("doc_id", "h", "passage_id", "offset").agg(F.count("*").alias("hits")).join(items.withColumn("length", length), "passage_id")
    met = staged(met.where("hits > 1 OR length = 1").select("doc_id", "h", "passage_id", "item_id", "offset", "length", "passage"), "alignments")
    one = met.where("length = 1").select("doc_id", "item_id", F.col("offset").alias("low"), F.col("offset").alias("high"))
    longer = met.where("length > 1")
    # the other words: postings of these documents along the items only
    ranges = longer.groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("offset").alias("low"), (F.col("offset") + F.col("length") - 1).alias("high"))).alias("ranges"))
    ranges = staged(ranges.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "ranges"), "ranges")
    texts = docs.select("doc_id", "text").join(ranges, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_h"))).select("doc_id", "text", "ranges")
    words = longer.select("passage").distinct().select(F.explode(F.split("passage", " ")).alias("word")).distinct()
    along = staged(postings(texts, words, ranges="ranges"), "postings").where("word IS NOT NULL").distinct().select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), F.col("pos").alias("_pos"), F.col("word").alias("_word"))
    wanted = longer.select("doc_id", "h", "passage_id", "item_id", "offset", "length", F.posexplode(F.split("passage", " ")).alias("k", "word"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")) & (F.col("offset") + F.col("k") == F.col("_pos")) & (F.col("word") == F.col("_word"))
    hits = wanted.join(along, same)
    nth = F.row_number().over(Window.partitionBy("doc_id", "h", "passage_id", "item_id", "offset").orderBy("k"))
    runs = hits.withColumn("run", F.col("k") - nth).groupBy("doc_id", "h", "passage_id", "item_id", "offset", "run").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("length").alias("length"))
    whole = runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), "length"))
    return one.unionByName(whole.select("doc_id", "item_id", (F.col("offset") + F.col("first")).alias("low"), (F.col("offset") + F.col("last")).alias("high")))


def near_pairs(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(doc_id, a, b, pos_a, pos_b): neighbouring occurrences of the words of ``pairs`` (a, b) fewer than ``within`` words apart, in any order.

    Of a run of occurrences those that are next to each other in the merged lists are given; a word can pair with itself.
    """
    known = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    listed = index.where("word IS NOT NULL")
    first = listed.join(known.withColumn("word", F.col("a")), "word").withColumn("side", F.lit(0))
    second = listed.join(known.where("a <> b").withColumn("word", F.col("b")), "word").withColumn("side", F.lit(1))
    order = Window.partitionBy("doc_id", "h", "a", "b").orderBy("pos", "side")
    both = first.unionByName(second).distinct().select("doc_id", "a", "b", "pos", "side", F.lag("pos").over(order).alias("before"), F.lag("side").over(order).alias("was"))
    met = both.where((F.col("pos") - F.col("before") < within) & ((F.col("side") != F.col("was")) | (F.col("a") == F.col("b"))))
    return met.select("doc_id", "a", "b", F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("before")).alias("pos_a"), F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("pos")).alias("pos_b"))


def proximity_matches(docs: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(doc_id, a, b, pos_a, pos_b) of ``near_pairs`` in an index of ``docs`` (doc_id, text) made for the words of the pairs."""
    words = pairs.select(F.explode(F.array("a", "b")).alias("word")).where("word IS NOT NULL").distinct()
    return near_pairs(staged(postings(docs, words), "postings"), pairs, within)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, one_in: int = 20, proximity: bool = False) -> DataFrame:
    """Hits of benchmark ``items`` (item_id, text) in ``docs`` (doc_id, text).

    A window is ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window.  Returns per doc_id: n_words, n_hit (words inside any
    occurrence of a window), items (sorted array of the ids with occurring windows)
    and contaminated (n_hit > 0 and ``one_in`` * n_hit >= n_words).  With ``proximity`` also n_near: the number of items
    of which the two rarest words of some window stand fewer than ``window`` words apart.

    Null texts have no words; items without words or id match nothing.  Rows that
    share a doc_id (or have none) give one row: hits are pooled, n_words is the
    longest text's.  Empty tables give no rows, or no hits.
    """
    texts = staged(passages(items).withColumn("passage_id", F.xxhash64("item_id", "passage")), "passages")
    words = staged(texts.select(F.explode(F.split("passage", " ")).alias("word")).distinct(), "words")
    rare = staged(rare_words(texts, word_counts(docs, words), window), "rare")
    sought = rare.select(F.explode(F.array("word", "other")).alias("word")).where("word IS NOT NULL").distinct()
    index = staged(postings(docs, sought), "postings")
    hits = phrase_matches(docs, index, texts, rare, window)
    joined = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["high"] - F.greatest(s["low"] - 1, a["end"]))).alias("n"), F.greatest(a["end"], s["high"]).alias("end")),
        lambda a: a["n"],
    )
    per_doc = hits.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")).select("_doc", joined.alias("n_hit"), "items")
    sizes = index.where("word IS NULL").groupBy("doc_id").agg(F.max("pos").alias("n_words"))
    out = sizes.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    columns = ["doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated")]
    if proximity:
        pairs = rare.join(texts, "passage_id").select(F.col("word").alias("a"), F.col("other").alias("b"), "item_id")
        found = near_pairs(index, pairs, window).select("doc_id", "a", "b").distinct().join(pairs.distinct(), ["a", "b"])
        near = found.groupBy(F.col("doc_id").alias("_near_doc")).agg(F.countDistinct("item_id").alias("near"))
        out = out.join(near, F.col("doc_id").eqNullSafe(F.col("_near_doc")), "left")
        columns.append(F.coalesce("near", F.lit(0).cast("long")).alias("n_near"))
    return out.select(*columns)
