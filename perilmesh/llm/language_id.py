"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters inside
words, with word ends) of a language, most frequent first.  A document's own list is
compared with each profile by out-of-place distance: the sum, over its n-grams,
of how far their ranks differ, or the length of a profile where one is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, held_out, staged

UNDETERMINED = "und"
#: So many profile entries are sent to every task at a time.
MOST_ENTRIES = 2_000_000
_SPACE, _BITS = 32, 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as packed code points, and their counts; empty without letters."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, _SPACE)
    space = codes == _SPACE
    codes = codes[~(space & np.concatenate(([False], space[:-1])))]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = codes[:-1] << _BITS | codes[1:]
    three = two[:-1] << _BITS | codes[2:]
    return np.unique(np.concatenate((codes[codes != _SPACE], two, three[codes[1:-1] != _SPACE])), return_counts=True)


def _ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` most frequent n-grams, ties by code."""
    if len(grams) > length:
        cut = np.partition(counts, len(counts) - length)[len(counts) - length]
        kept = counts >= cut
        grams, counts = grams[kept], counts[kept]
    return grams[np.lexsort((grams, -counts))][:length]


class Profiles:
    """Profiles of languages as one table of ranks, by n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int):
        """rows: (language, rank from 0, n-gram)."""
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        self.length = length
        self.languages = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.languages)}
        self.of = np.array([number[r[0]] for r in rows], np.int32)
        self.ranks = np.array([r[1] for r in rows], np.int32)
        self.grams, self.starts = np.unique(np.array([r[2] for r in rows], np.int64), return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(rows)))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each language."""
        far = np.full(len(self.languages), float(self.length * len(own)))
        if not len(self.grams):
            return far
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.flatnonzero(self.grams[at] == own)
        sizes = self.sizes[at[places]]
        entry = np.repeat(self.starts[at[places]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.abs(self.ranks[entry] - np.repeat(places, sizes))
        return far + np.bincount(self.of[entry], out - float(self.length), len(self.languages))

    def nearest(self, text: str | None) -> list[tuple[float, str]]:
        """The two nearest languages, fewer if there are fewer; none without letters.  Ties go by code point."""
        own = _ranked(*ngrams(text), self.length)
        if not len(own):
            return []
        far = self.distances(own)
        return [(float(far[i]), self.languages[i]) for i in np.argsort(far, kind="stable")[:2]] + [(float(self.length * len(own)), "")] * (len(far) < 2)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language, and by how much its distance is below the second nearest's, as a share."""
        return judged(self.nearest(text))


def judged(nearest: list[tuple[float, str]]) -> tuple[str, float]:
    """Language and score of the two nearest of (distance, language); a distance without a language is that of no profile."""
    found = sorted((x for x in nearest if x[1]), key=lambda x: (x[0], x[1]))
    if not found:
        return UNDETERMINED, 0.0
    best = found[0]
    second = found[1][0] if len(found) > 1 else max(x[0] for x in nearest)
    return best[1], (second - best[0]) / second if second else 0.0


def fit_profiles(docs: DataFrame, *, length: int = 300, sample: int = 2000) -> list[Profiles]:
    """Profiles from (doc_id, text, lang) rows that are not held out and have a language.

    About ``sample`` documents of each language, drawn by hash of the doc_id, are counted: a
    language with fewer is counted whole.  Rows without a doc_id are not learned from.  The languages are
    returned in blocks of up to ``MOST_ENTRIES`` profile entries, in code point order; one block, as a rule.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "text", "lang")
    per_lang = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11).cast("double") * F.lit(2.0**-53)

    def run(batches: Batches) -> Batches:
        for b in batches:
            langs, grams, counts = [], [], []
            texts: dict[str, list[str]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for part in _blocks(own):
                    g, n = ngrams(" ".join(part))
                    langs += [lang] * len(g)
                    grams.append(g)
                    counts.append(n)
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

    drawn = rows.join(per_lang, "lang").where(draw < F.col("share")).select("lang", "text")
    counted = drawn.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = staged(counted.withColumn("rank", rank - 1).where(F.col("rank") < length).select("lang", "rank", "gram"), "profiles")
    languages = sorted(r["lang"] for r in top.select("lang").distinct().collect())
    each = max(1, MOST_ENTRIES // length)
    blocks = [languages[i : i + each] for i in range(0, len(languages), each)]
    return [Profiles([(r["lang"], r["rank"], r["gram"]) for r in top.where(F.col("lang").between(b[0], b[-1])).collect()], length) for b in blocks]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts, so many at a time as make a bounded number of characters."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held > 1 << 19:
            yield part
            part, held = [], 0
    if part:
        yield part


def identify(docs: DataFrame, profiles: list[Profiles]) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text), from whole texts alone.

    lang_pred is a learned language, or ``und`` with score 0 if the text is null or has
    no letter (or nothing was learned).  score is the margin to the second
    nearest profile, 0 to 1.  Equal distances go to the first language by code point.  A block of profiles is
    broadcast at a time; what its languages reach is carried along the row to the next.
    """
    found = docs.select("doc_id", "text", F.lit(None).cast("array<struct<far:double,lang:string>>").alias("near"))
    kind = pa.list_(pa.struct([("far", pa.float64()), ("lang", pa.string())]))

    def run(batches: Batches, model) -> Batches:
        for b in batches:
            near = []
            for text, so_far in zip(b["text"].to_pylist(), b["near"].to_pylist()):
                both = [(x["far"], x["lang"]) for x in so_far or ()] + model.value.nearest(text)
                near.append([{"far": f, "lang": x} for f, x in sorted((x for x in both if x[1]), key=lambda x: (x[0], x[1]))[:2] + [x for x in both if not x[1]][:1]])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(near, kind)], ["doc_id", "text", "near"])

    for block in profiles:
        model = docs.sparkSession.sparkContext.broadcast(block)
        found = found.mapInArrow(lambda batches, model=model: run(batches, model), found.schema)

    def last(batches: Batches) -> Batches:
        for b in batches:
            got = [judged([(x["far"], x["lang"]) for x in near or ()]) for near in b["near"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return found.select("doc_id", "near").mapInArrow(last, "doc_id long, lang_pred string, score double")
