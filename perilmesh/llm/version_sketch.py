"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is the set of the digests of its paragraphs, which end by content: at line and sentence ends, after words whose
hash says so (one in three), and after three words at most.  One rule holds for texts of every size, and an edit changes
the paragraphs around it only.  A paragraph's repetitions count as further ones.  A sketch has three tables of cells; each digest goes into one cell of each,
adding to a count and combining by exclusive or into a key and a check sum.  The
difference of two sketches holds exactly the digests that one text has and the other
lacks; a cell with a single one of them gives it away, and taking it out lays others
open (peeling).  If that gets stuck, larger sketches of both texts are tried.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cuts

_CUT = re.compile(r"[.!?\n](?:(?<=\n)|\s+)")  # marks before white space, and line ends; one class first is searched for fast
_FAR = -(1 << 63)
#: A paragraph ends after a word whose hash is divisible by _ENDS, or after three words.
_ENDS = 3
#: Runs of more letters than _LONG are cut into words after letters whose code point is divisible by 8.
_LONG = 24
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_hash = xxhash.xxh3_64_intdigest


def _words(piece: str) -> list[str]:
    words = piece.split()
    if not words or max(map(len, words)) <= _LONG:
        return words
    out = []
    for w in words:
        start = 0
        if len(w) > _LONG:
            for i, c in enumerate(w, 1):
                if ord(c) % 8 == 0:
                    out.append(w[start:i])
                    start = i
        if start < len(w):
            out.append(w[start:])
    return out


def _of_piece(piece: str) -> list[int]:
    words = _words(piece)
    out, i, n = [], 0, len(words)
    while i < n:
        h = _hash(words[i])
        if h % _ENDS == 0 or i + 1 == n:
            out.append(h)
            i += 1
        elif i + 2 < n and _hash(words[i + 1]) % _ENDS:
            out.append(_hash(" ".join(words[i : i + 3])))
            i += 3
        else:
            out.append(_hash(f"{words[i]} {words[i + 1]}"))
            i += 2
    return out


def digests(text: str, known: dict[str, list[int]] | None = None) -> set[int]:
    """64-bit digests of the paragraphs of a text, repetitions with their number.

    ``known`` keeps what sentences give, for another version of the text.
    """
    known = {} if known is None else known
    every: list[int] = []
    for piece in _CUT.split(text):
        own = known.get(piece)
        if own is None:
            own = known[piece] = _of_piece(piece)
        every += own
    out = set(every)
    if len(out) < len(every):
        for h, times in Counter(every).items():
            for n in range(1, times):
                out.add((h ^ n * _ODD) & _MASK)
    return out


_SHIFTS, _TABLES = np.array([[0], [21], [42]], np.uint64), np.array([[0], [1], [2]])
_CELL = np.dtype([("n", "<i2"), ("key", "<u8"), ("check", "<u4")])


def _check(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(_ODD)) >> np.uint64(32)


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cells of each key, table after table."""
    cells = keys >> _SHIFTS
    if width & width - 1:
        cells %= np.uint64(width)
    else:
        cells &= np.uint64(width - 1)
    cells = cells.view(np.int64)
    cells += _TABLES * width
    return cells.ravel()


class Sketch:
    """3 * width cells: counts, keys and check sums."""

    __slots__ = ("width", "counts", "keys", "checks")

    def __init__(self, width: int, keys=()):
        self.width = width
        self.counts = np.zeros(3 * width, np.int64)
        self.keys, self.checks = np.zeros(3 * width, np.uint64), np.zeros(3 * width, np.uint64)
        if len(keys):
            own = keys if isinstance(keys, np.ndarray) else np.fromiter(keys, np.uint64, len(keys))
            cells = _cells(own, width)
            self.counts += np.bincount(cells, minlength=3 * width)
            self._mix(own, cells)

    def _mix(self, keys: np.ndarray, cells: np.ndarray) -> None:
        """Combine keys and check sums into their cells, table after table."""
        times, checks = len(cells) // len(keys), _check(keys)
        np.bitwise_xor.at(self.keys, cells, np.concatenate((keys,) * times))
        np.bitwise_xor.at(self.checks, cells, np.concatenate((checks,) * times))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch.__new__(Sketch)
        out.width = self.width
        out.counts, out.keys, out.checks = self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[set[int], set[int]] | None:
        """Digests only in the first and only in the second text; None if stuck.  Empties the sketch, all open cells of a table at a time."""
        w, found, signs = self.width, [], []
        stuck = t = 0
        for _ in range(9 * w + 3):  # of three tables on end one at least has a cell emptied
            counts = self.counts[t * w : t * w + w]
            open_ = np.flatnonzero(counts * counts == 1)
            open_ += t * w
            keys = self.keys[open_]
            pure = self.checks[open_] == _check(keys)
            if not pure.all():
                open_, keys = open_[pure], keys[pure]
            n = len(keys)
            if n:
                sign, cells = self.counts[open_], _cells(keys, w)
                found.append(keys)
                signs.append(sign)
                self.counts[open_] = self.keys[open_] = self.checks[open_] = 0
                others = cells[n:] if t == 0 else cells[: 2 * n] if t == 2 else np.concatenate((cells[:n], cells[2 * n :]))
                np.subtract.at(self.counts, others, np.concatenate((sign, sign)))
                self._mix(keys, others)
                stuck = 0
            else:
                stuck += 1
                if stuck == 3:
                    break
            t = (t + 1) % 3
        if self.counts.any() or self.keys.any():
            return None
        if not found:
            return set(), set()
        keys, sign = np.concatenate(found), np.concatenate(signs)
        return set(keys[sign == 1].tolist()), set(keys[sign == -1].tolist())

    def text(self) -> str:
        """The sketch as a string: 14 bytes a cell, in base64."""
        cells = np.empty(len(self.counts), _CELL)
        cells["n"], cells["key"], cells["check"] = self.counts, self.keys, self.checks
        return base64.b64encode(cells.tobytes()).decode()


#: Sketches up to this width are kept for another difference of the same text.
_KEPT = 1 << 14


class Digests:
    """Distinct digests of a text, with the sketches made of them so far."""

    __slots__ = ("keys", "sketches")

    def __init__(self, keys):
        self.keys, self.sketches = np.fromiter(keys, np.uint64, len(keys)), {}

    def __len__(self) -> int:
        return len(self.keys)

    def sketch(self, width: int) -> Sketch:
        found = self.sketches.get(width)
        if found is None:
            found = Sketch(width, self.keys)
            if width <= _KEPT:
                self.sketches[width] = found
        return found


def difference(a: set[int] | Digests, b: set[int] | Digests, sketch_a: Sketch, sketch_b: Sketch) -> tuple[set[int], set[int]]:
    """What only ``a`` and only ``b`` has, by peeling; larger sketches follow on failure."""
    first = sketch_a.minus(sketch_b)
    # a table's counts, squared, sum up to the number of differing digests about; of far more than there are cells none comes out
    found = first.peel() if (first.counts**2).sum() <= 24 * first.width else None
    if found is not None:
        return found
    a, b = (x if isinstance(x, Digests) else Digests(x) for x in (a, b))
    # ample room for a full difference: few rounds of peeling.  A power of two, above _KEPT at most the number of digests
    n = len(a) + len(b) + 4
    width = max(2 * sketch_a.width, 1 << ((n - 1).bit_length() if n <= _KEPT else n.bit_length() - 1))
    while found is None:
        found = a.sketch(width).minus(b.sketch(width)).peel()
        width *= 2
    return found


def likeness(a: set[int] | Digests, b: set[int] | Digests, sketch_a: Sketch, sketch_b: Sketch) -> float:
    """Shared digests as a share of all, from the recovered difference; 1 if neither has any."""
    only_a, only_b = difference(a, b, sketch_a, sketch_b)
    shared = len(a) - len(only_a)
    every = shared + len(only_a) + len(only_b)
    return shared / every if every else 1.0


def edited(text: str, after: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def versions(docs: DataFrame, *, width: int = 8, ranges: int | None = None) -> DataFrame:
    """Each of ``docs`` (doc_id, text) beside its edited version and its next document.

    The next document is that with the next smaller doc_id, after the smallest the
    one with the largest.  Returns one row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (sketches of 3 * ``width`` cells), near_edited and near_next.

    A null text is empty; two texts without paragraphs are alike (1).  Rows without
    a doc_id come last, repeated ids in the order of their texts.  doc_ids are dealt
    into ``ranges`` (spark.sql.shuffle.partitions by default) of like size; texts move once, and the first
    document of each range also goes to the range that ends with its predecessor.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_FAR)).alias("_k"), F.coalesce("text", F.lit("")).alias("text"))
    at = cuts(keyed, "_k", n)
    place = F.size(F.filter(F.array(*map(F.lit, at)).cast("array<bigint>"), lambda c: c < F.col("_k"))) if at else F.lit(0)
    placed = keyed.withColumn("_range", place)
    firsts = {r["_range"]: r["k"] for r in placed.groupBy("_range").agg(F.max("_k").alias("k")).collect()}  # a row per range
    filled = sorted(firsts)
    lent = {firsts[r]: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    if lent:
        lend = F.broadcast(spark.createDataFrame(list(lent.items()), "_k long, _to int"))  # at most a row per range
        placed = placed.join(lend, "_k", "left").withColumn("_to", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("b")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("b")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("b"))))))
    else:
        placed = placed.withColumn("_to", F.struct(F.col("_range").alias("r"), F.lit(0).alias("b")))
    # numbers whose hashes lie one in each of n partitions, so that each task gets a range
    dealing = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("number")).collect()
    number = {r["part"]: r["number"] for r in dealing}
    deal = F.element_at(F.array(*(F.lit(number.get(i, i)) for i in range(n))), F.col("_range") + 1)
    dealt = placed.select("doc_id", "_k", "text", F.col("_to.r").alias("_range"), F.col("_to.b").alias("_lent")).repartition(n, deal).sortWithinPartitions("_range", "_lent", F.desc("_k"), "text")

    def run(batches: Batches) -> Batches:
        before = None  # the document that waits for its next one: range, id, text, digests, sketch, what its sentences give
        for b in batches:
            out = []
            for i, text, part, lent in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "_range", "_lent"))):
                if lent and (before is None or before[0] != part):
                    continue
                known: dict[str, list[int]] = {}
                own = Digests(digests(text, known))
                sketch = own.sketch(width)
                if before is not None:
                    _, old, was, had, drawn, seen = before
                    new = edited(was, text)
                    has = Digests(digests(new, known | seen))
                    other = has.sketch(width)
                    out.append((old, len(was), sha256(new.encode()).hexdigest(), drawn.text(), other.text(), likeness(had, has, drawn, other), likeness(had, own, drawn, sketch)))
                before = None if lent else (part, i, text, own, sketch, known)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return dealt.select("doc_id", "text", "_range", "_lent").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
