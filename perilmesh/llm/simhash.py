"""SimHash fingerprints and near-duplicate classes by anchor-point covering.

Anchors are the words of a covering code: the perfect Hamming code of length 63
times both values of the last bit, so every 64-bit word has an anchor within
covering radius 1.  Two fingerprints at most 2 bits apart have a midpoint
within 1 bit of both; the midpoint has an anchor within 1 bit; so both are
within 2 bits, covering radius plus half the threshold, of a common anchor.
Each distinct fingerprint is sent to its (at most 33) anchors within that
distance, and only fingerprints that meet at an anchor are compared.  A ball of
radius 2 has 2081 words, which bounds every anchor's group whatever the data.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, binary, staged
from .components import components

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)))) if n > 1 else [b" ".join(words)]
    h = np.fromiter(map(_hash, shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, words_each: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row; a null text has no words."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            found = np.array([fingerprint(t or b"", words_each) for t in binary(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=2)
def _flips(length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the masks that turn a word of it into its code words within 2 bits, and how many there are."""
    bit = lambda p: 1 << (p - 1)
    rows = []
    for s in range(length + 1):
        near = bit(s) if s else 0
        rows.append([near, near ^ 1 << length] + [bit(i) ^ bit(i ^ s) for i in range(1, length + 1) if s and i ^ s > i])
    table = np.zeros((length + 1, max(map(len, rows))), np.uint64)
    for s, row in enumerate(rows):
        table[s, : len(row)] = row
    return table, np.array([len(r) for r in rows])


def anchors(words: np.ndarray, length: int = 63) -> tuple[np.ndarray, np.ndarray]:
    """All code words within 2 bits of each of ``words`` (uint64 of length + 1 bits, length is 63 or 31), and whose they are.

    The syndrome of the lower bits is the exclusive or of the positions (1 to length) of its ones;
    flipping bits whose positions combine to the syndrome gives a code word.
    """
    syndrome = np.zeros(len(words), np.int64)
    for k in range(length.bit_length()):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, length + 1) if p >> k & 1))
        syndrome |= (np.bitwise_count(words & mask) & 1).astype(np.int64) << k
    table, sizes = _flips(length)
    found = words[:, None] ^ table[syndrome]
    used = np.arange(table.shape[1]) < sizes[syndrome][:, None]
    return found[used], np.repeat(np.arange(len(words)), sizes[syndrome])


def _forest(fps: list[int], ids: list[int], most: int) -> list[tuple[int, int]]:
    """Links that connect what lies within ``most`` bits in one anchor's group."""
    if len(fps) == 2:
        return [(ids[0], ids[1])] if ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= most else []
    x, todo, out = np.array(fps, np.int64), set(range(len(fps))), []
    while todo:
        first = todo.pop()
        ahead = [first]
        while ahead and todo:
            rest = np.fromiter(todo, np.int64, len(todo))
            near = rest[np.bitwise_count((x[rest] ^ x[ahead.pop()]).view(np.uint64)) <= most].tolist()
            todo.difference_update(near)
            ahead += near
            out += [(ids[first], ids[i]) for i in near]
    return out


def links(classes: DataFrame, *, most: int = 2) -> DataFrame:
    """Links (a, b) between classes (fp, id) at most ``most`` (up to 2) differing bits apart.

    Not every close pair is listed, but whatever close pairs connect is
    connected by the links: per anchor a spanning forest is returned.
    """
    if not 0 <= most <= 2:
        raise ValueError("the covering serves thresholds of 0 to 2 bits")
    def at_anchors(batches: Batches) -> Batches:
        for b in batches:
            fps, ids = (b[c].to_numpy() for c in ("fp", "id"))
            for i in range(0, len(fps), 4096):
                found, owner = anchors(fps[i : i + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fps[i : i + 4096][owner]), pa.array(ids[i : i + 4096][owner]), pa.array(found.view(np.int64))], ["fp", "id", "anchor"])

    met = (
        classes.where("id IS NOT NULL").select("fp", "id").mapInArrow(at_anchors, "fp long, id long, anchor long")
        .repartition("anchor").groupBy("anchor").agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids"))
        .where(F.size("fps") > 1)
    )

    def run(batches: Batches) -> Batches:
        for b in batches:
            found = [pair for fps, ids in zip(b["fps"].to_pylist(), b["ids"].to_pylist()) for pair in _forest(fps, ids, most)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.select("fps", "ids").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words_each: int = 3, most: int = 2, similarity: float | None = None) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links reach: of at most ``most`` differing
    bits and, if ``similarity`` is given, of at least that Jaccard similarity of
    five-word shingles (``similar_links``).  Texts that are null or without words have
    fingerprint zero and are linked like any other.  Repeated rows repeat.  A row with a
    null doc_id gets the component of its fingerprint and links nothing itself.
    """
    sketches = staged(fingerprints(docs, words_each=words_each), "sketches")
    classes = staged(sketches.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    every = links(classes, most=most)
    if similarity is not None:
        own = sketches.where("doc_id IS NOT NULL").join(classes, "fp").select("doc_id", "id")
        more = staged(similar_links(docs, least=similarity), "similar")
        for side in ("a", "b"):  # links between documents become links between classes
            more = more.join(own.select(F.col("doc_id").alias(side), F.col("id").alias(f"_{side}")), side)
        every = every.unionByName(more.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    found = components(every)
    named = staged(classes.join(found, F.col("id") == F.col("member"), "left").select("fp", F.coalesce("component", "id").alias("component_id")), "named")
    out = sketches.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------- documents of a given similarity


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def _grams(words: np.ndarray, each: int) -> np.ndarray:
    """Hashes of runs of ``each`` word hashes."""
    n = len(words) - each + 1
    return _mixed(sum(_mixed(words[k : k + n] + _ODD[k % 8]) * _ODD[(k + 1) % 8] for k in range(each)))


def wide_fingerprint(text: bytes) -> tuple[int, int]:
    """128 bits over the distinct words and word pairs of a text: few edits flip few of them."""
    return _wide(word_hashes(text))


def _wide(words: np.ndarray) -> tuple[int, int]:
    if not len(words):
        return 0, 0
    h = np.unique(np.concatenate((words, _grams(words, 2)))) if len(words) > 1 else words
    out = []
    for odd in _ODD[:2]:
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            x = h[i : i + 65536] * odd
            x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little"))
    return out[0], out[1]


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (of the whole text, if it has fewer words)."""
    return _shingles(word_hashes(text), words_each)


def _shingles(words: np.ndarray, words_each: int) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.int64)
    return np.unique(_grams(words, min(words_each, len(words))).view(np.int64))


_BINS = 128


def small_sketch(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of sorted shingle hashes that tell sets of unlike content apart.

    Of up to 128 shingles, the parities of the numbers of shingles per bin: two sets differ in at most as
    many bits as in elements.  Of more, a bit of the least hash in each bin: bits differ with half the
    chance that the least hashes do, which is one less the similarity.
    """
    bins = (shingles.view(np.uint64) >> np.uint64(57)).astype(np.int64)
    if len(shingles) <= _BINS:
        bits = np.bincount(bins, minlength=_BINS) & 1
    else:
        order = np.argsort(shingles.view(np.uint64), kind="stable")
        ordered = shingles.view(np.uint64)[order]
        places = np.minimum(np.searchsorted(ordered, np.arange(_BINS, dtype=np.uint64) << np.uint64(57)), len(ordered) - 1)
        bits = (ordered[places] >> np.uint64(13) & np.uint64(1)).astype(np.int64)
    low, high = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()
    return low, high


_ROW = "key long, block int, id long, w0 long, w1 long, s0 long, s1 long, n long, label long, home boolean"
_NUMBERS = ("id", "w0", "w1", "s0", "s1", "n", "label")


def _alike(n: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles whose small sketches differ in ``bits`` bits may be 0.8 similar.

    The bound on parities is exact; that on least hashes leaves out a pair of similarity 0.8 in one of ten thousand.
    """
    fits = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    return fits & np.where((n <= _BINS) & (m <= _BINS), 9 * bits <= n + m, ((n <= _BINS) | (m <= _BINS)) | (bits <= 26))


def _maybe(row: np.ndarray, others: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``others`` may be 0.8 similar to ``row``, by sizes and sketches; and the differing bits of the wide hash."""
    far = np.bitwise_count((others[:, 1:3] ^ row[1:3]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    bits = np.bitwise_count((others[:, 3:5] ^ row[3:5]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return _alike(others[:, 5], row[5], bits) & (far <= near), far


_MET = "key long, id long, s0 long, s1 long, n long"


def _partnered(rows: np.ndarray, most: int) -> np.ndarray:
    """Which of ``rows`` (key, id, s0, s1, n; sorted by key) may be similar to another one of their key; all of more than ``most``."""
    starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(rows)))
    keep = np.repeat(sizes > most, sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(rows))  # rows of the key from here on
    at = np.flatnonzero(~keep & (left > 1))
    step = 1
    while len(at):
        a, b = rows[at], rows[at + step]
        hit = at[_alike(a[:, 4], b[:, 4], np.bitwise_count((a[:, 2:4] ^ b[:, 2:4]).view(np.uint64)).sum(axis=1, dtype=np.int64))]
        keep[hit] = keep[hit + step] = True
        step += 1
        at = at[left[at] > step]
    return keep


def _meeting(batches: Batches, most: int = 256) -> Batches:
    """(key, id) of the rows that may be similar to another one at their anchor, by sizes and small sketches.

    Most rows that share an anchor do so by coincidence, and such pairs grow with the square of the number of
    texts; they end here.  Rows come sorted by key.  Anchors of more than ``most`` rows pass whole, so a row is compared with fewer than that.
    """
    held, crowd = np.empty((0, 5), np.int64), None  # the last key's rows, which may go on; the last key, if it has passed ``most``
    for b in batches:
        rows = np.concatenate((held, np.stack([b[c.split()[0]].to_numpy() for c in _MET.split(", ")], axis=1)))
        if not len(rows):
            continue
        past = np.searchsorted(rows[:, 0], crowd, "right") if crowd is not None else 0
        last = np.searchsorted(rows[:, 0], rows[-1, 0])
        if len(rows) - last > most or last < past:
            crowd, end = rows[-1, 0], len(rows)
        else:
            crowd, end = None, last
        done, held = rows[:end], rows[end:]
        done = done[np.concatenate((np.ones(past, bool), _partnered(done[past:], most)))]
        yield pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], ["key", "id"])
    done = held[_partnered(held, most)]
    yield pa.RecordBatch.from_arrays([pa.array(done[:, 0]), pa.array(done[:, 1])], ["key", "id"])


def _groups(batches: Batches):
    """(key and block, rows, home flags) of each group of rows that are sorted by key and block."""
    at, own, homes = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b["key"].to_numpy(), b["block"].to_numpy().astype(np.int64)], axis=1)
        rows = np.stack([b[c].to_numpy() for c in _NUMBERS], axis=1)
        home = b["home"].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            if at is None or (keys[s] != at).any():
                if own:
                    yield np.concatenate(own), np.concatenate(homes)
                at, own, homes = keys[s], [], []
            own.append(rows[s:e])
            homes.append(home[s:e])
    if own:
        yield np.concatenate(own), np.concatenate(homes)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def _led(batches: Batches, near: int) -> Batches:
    """Few candidate pairs (a, b) that are likely to connect a group: each row with its nearest leader, leaders among rows of none.

    Rows go in the order of their distance to the group's majority bits, so that a text of which many are
    versions leads them.  Rows of one label are taken for connected.
    """
    out: list[tuple[int, int]] = []
    for rows, _ in _groups(batches):
        if len(rows) > 2:
            ones = np.unpackbits(rows[:, 1:3].copy().view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            rows = rows[np.argsort((ones != (2 * ones.sum(axis=0, dtype=np.int64) > len(rows))).sum(axis=1), kind="stable")]
        leaders, n = np.empty_like(rows), 0
        for row in rows:
            may, far = _maybe(row, leaders[:n], near)
            may &= leaders[:n, 6] != row[6]
            if may.any():
                out.append((int(row[0]), int(leaders[np.where(may, far, 1 << 30).argmin(), 0])))
            else:
                leaders[n], n = row, n + 1
        if len(out) > 100_000:
            yield _pairs(out)
            out = []
    yield _pairs(out)


def _across(batches: Batches, near: int) -> Batches:
    """All candidate pairs (a, b) of unlike label in each group, of which at least one is at home there."""
    out: list[tuple[int, int]] = []
    for rows, home in _groups(batches):
        for at in np.flatnonzero(home):
            row = rows[at]
            may, _ = _maybe(row, rows, near)
            may &= (rows[:, 6] != row[6]) & (~home | (rows[:, 0] < row[0]))
            out += [(int(row[0]), int(i)) for i in rows[may, 0]]
            if len(out) > 100_000:
                yield _pairs(out)
                out = []
    yield _pairs(out)


def similar_links(docs: DataFrame, *, words_each: int = 5, least: float = 0.8, near: int = 32, block: int = 4096) -> DataFrame:
    """Links (a, b) of doc_ids whose texts' word shingles have a Jaccard similarity of ``least`` (0.8 or more).

    Candidates come from anchors over the four 32-bit quarters of a 128-bit SimHash of words and
    word pairs: texts that differ in at most 2 bits of a quarter meet (about 95 % of
    those with similarity 0.8, more of nearer ones).  Every link is checked on whole texts.

    Not every pair that meets is checked, but each is either checked, ruled out by sketches (``_meeting``, ``_maybe``), or within one
    component of the links already found.  First the rows of each anchor are checked with leaders, in blocks of
    about ``block`` rows, then one row of each component there; last all pairs between components.  For that
    an anchor's rows of its largest component are dealt into blocks and those of the others go to each block, so an anchor that
    a third of all texts share is spread, and its work is the size of the largest component times that of the rest.
    """
    if least < 0.8:
        raise ValueError("sizes and sketches rule out pairs below a similarity of 0.8")
    kept = docs.where("doc_id IS NOT NULL").select("doc_id", "text")

    def sketch(batches: Batches) -> Batches:
        for b in batches:
            found, small, sizes, same_words = [], [], [], []
            for text in binary(b["text"]):
                words = word_hashes(text or b"")
                shingles = _shingles(words, words_each)
                found.append(_wide(words))
                small.append(small_sketch(shingles) if len(shingles) else (0, 0))
                sizes.append(len(shingles))
                same_words.append(xxhash.xxh3_128_digest(words.tobytes()))
            found, small = np.array(found, np.uint64).reshape(-1, 2).view(np.int64), np.array(small, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x[:, i]) for x in (found, small) for i in (0, 1)), pa.array(sizes, pa.int64()), pa.array(same_words, pa.binary())], ["id", "w0", "w1", "s0", "s1", "n", "words"])

    # texts of the same words in order have equal fingerprints, which link them; all others go on, even under one hash
    each = kept.mapInArrow(sketch, "id long, w0 long, w1 long, s0 long, s1 long, n long, words binary").where("n > 0")
    wide = staged(each.groupBy("w0", "w1", "s0", "s1", "n", "words").agg(F.min("id").alias("id")).drop("words"), "wide")

    def at_anchors(batches: Batches) -> Batches:
        for b in batches:
            own, w = [b[c].to_numpy() for c in ("id", "s0", "s1", "n")], np.stack([b[c].to_numpy() for c in ("w0", "w1")], axis=1)
            for i in range(0, len(w), 4096):
                quarters = np.ascontiguousarray(w[i : i + 4096]).view(np.uint32).astype(np.uint64)
                for k in range(4):
                    found, owner = anchors(quarters[:, k], 31)
                    yield pa.RecordBatch.from_arrays([pa.array((found | np.uint64(k << 32)).view(np.int64)), *(pa.array(x[i : i + 4096][owner]) for x in own)], [c.split()[0] for c in _MET.split(", ")])

    # anchors are hashed into partitions with all that is needed to rule out those who meet by coincidence
    met = staged(wide.mapInArrow(at_anchors, _MET).repartition("key").sortWithinPartitions("key").mapInArrow(_meeting, "key long, id long"), "met")
    crowded = staged(met.groupBy("key").count(), "crowded")
    crowds = met.join(crowded, "key")  # key, id, count

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with key, block, id, label and home, beside their sketches, sorted in their groups."""
        return rows.join(wide, "id").select(*(c.split()[0] for c in _ROW.split(", "))).repartition("key", "block").sortWithinPartitions("key", "block")

    of_block = lambda rows: F.pmod(F.xxhash64("id"), F.ceil(rows / F.lit(float(block)))).cast("int")
    alone = crowds.select("key", "id", of_block(F.col("count")).alias("block"), F.col("id").alias("label"), F.lit(True).alias("home"))
    pairs = staged(dealt(alone).mapInArrow(lambda b: _led(b, near), "a long, b long").distinct(), "pairs")
    found, tried = _checked(kept, pairs, words_each, least), pairs

    def labelled(rows: DataFrame) -> DataFrame:
        """(key, id, label) of the anchors that have rows of more than one component."""
        named = rows.join(components(found), F.col("id") == F.col("member"), "left").select("key", "id", F.coalesce("component", "id").alias("label"))
        split = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return staged(named.join(split, "key", "left_semi"), "crowds")

    crowds = labelled(crowds.select("key", "id"))
    if crowds.isEmpty():
        return found
    if not crowded.where(F.col("count") > block).isEmpty():
        # blocks were cut: of each component at an anchor the row with the most links goes on to another round of leaders
        ends = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
        hubs = crowds.join(ends, "id", "left").groupBy("key", "label").agg(F.max_by("id", F.coalesce("links", F.lit(0)) * F.lit(1.0) - F.col("id") * F.lit(2.0**-64)).alias("id"))
        many = hubs.groupBy("key").agg(F.count("*").alias("count"))
        chosen = hubs.join(many, "key").select("key", "id", of_block(F.col("count")).alias("block"), "label", F.lit(True).alias("home"))
        more = staged(dealt(chosen).mapInArrow(lambda b: _led(b, near), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried, found = tried.unionByName(more), found.unionByName(_checked(kept, more, words_each, least))
        crowds = labelled(crowds.select("key", "id"))
        if crowds.isEmpty():
            return found
    sizes = crowds.groupBy("key", "label").agg(F.count("*").alias("rows"))
    largest = staged(sizes.groupBy("key").agg(F.max(F.struct("rows", "label")).alias("top"), F.sum("rows").alias("rows")).select("key", F.col("top.label").alias("main"), F.ceil(F.col("rows") / F.lit(float(block))).cast("int").alias("blocks")), "largest")
    spread = crowds.join(largest, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.when(F.col("label") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = spread.withColumn("block", F.explode(every)).select("key", "id", "block", "label", (F.col("block") == F.col("own")).alias("home"))
    more = staged(dealt(rows).mapInArrow(lambda b: _across(b, near), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(_checked(kept, more, words_each, least))


def _checked(docs: DataFrame, pairs: DataFrame, words_each: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts have the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def shingled(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([shingle_hashes(t or b"", words_each) for t in binary(b["text"])], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    sets = staged(docs.join(ids, "doc_id", "left_semi").mapInArrow(shingled, "doc_id long, shingles array<bigint>"), "shingles")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return staged(both.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct(), "checked")
