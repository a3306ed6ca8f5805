"""Toxicity by a support vector machine on a gapped-subsequence string kernel of sentences.

Sentences are read as overlapping spans of ``WORDS`` words.  The kernel of two spans is the sum
over their common subsequences of three and four characters, spaces included, each occurrence
weighing ``DECAY`` to the power of the characters it spans (``SPAN`` at most), scaled by
the roots of the spans' lengths.  So a span that has the letters of an insult in
order, with some put in or left out, or with a space inside, is still near it.

Labels are of documents, so training finds the sentence that bears witness: it begins with the span
of each toxic document whose subsequences have the highest log odds, and from then on takes the
one that the machine of the last round values highest.  Negatives are spans of clean documents, joined after each
round by those that the machine took for toxic.  A machine is Nyström's: spans are mapped by the
inverse root of the landmarks' kernel matrix, landmarks being spans of both kinds, and a linear SVM
(squared hinge) is trained there.  A document scores as its highest span.  For scoring, landmarks and
machine collapse into one weight per character tuple, as the kernel is linear in its subsequences.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, held_out, small_rows

WORDS, SPAN, DECAY = 2, 6, 0.7
#: Classes of characters: 0 space, 1 to 26 letters a to z, 27 digits, 28 to 42 other letters by code point, 43 the end of a sentence.
_CLASSES, _END, _MARK = 44, 43, 255
_OFFSETS = [(0, *rest) for p in (3, 4) for rest in combinations(range(1, SPAN), p - 1)]
_BASE = {3: 0, 4: _CLASSES**3}
_SIZE = _CLASSES**3 + _CLASSES**4
_BLOCK, _OVERLAP = 1 << 18, 256
_ROWS = 1024  # examples in hand at a time in training


def _class_of(code: int) -> int:
    c = chr(code)
    if c.isspace():
        return 0
    if "a" <= c <= "z":
        return 1 + code - 97
    return 28 + code % 15 if c.isalpha() else 27 if c.isdigit() else _MARK


_KNOWN = np.array([_class_of(c) for c in range(0x3000)], np.uint8)


@dataclass
class Spans:
    """Spans of some texts: character classes, and where each span begins, ends, and to which text it belongs."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray


def spans(texts: list[str]) -> Spans:
    """Spans of texts.  A sentence ends at a line end, or at one of ``.!?`` before white space; other marks inside words are left out."""
    lower = [t.lower() for t in texts]
    cp = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(-1, len(lower)), [1, *(len(t) + 1 for t in lower)])
    c = np.where(cp < 0x3000, _KNOWN[np.minimum(cp, 0x2FFF)], 28 + cp % 15).astype(np.uint8)
    stop = (cp == 46) | (cp == 33) | (cp == 63)
    sentence = (cp == 10) | ((c == 0) & np.concatenate(([False], stop[:-1])))
    kept = c != _MARK
    c, sentence, owner = c[kept], sentence[kept], owner[kept]
    space = c == 0
    first = space & np.concatenate(([True], ~space[:-1]))  # a run of spaces is one, and a sentence's end if any of it is
    ended = np.zeros(np.count_nonzero(first), bool)
    ended[(np.cumsum(first) - 1)[space & sentence]] = True
    kept = ~space | first
    c, owner, end = c[kept], owner[kept], np.zeros(np.count_nonzero(kept), bool)
    end[c == 0] = ended
    # behind a sentence's last space there are so many end marks that no tuple reaches the next one, which begins with a space
    room = np.where(end, 1 + SPAN, 1)
    at = np.cumsum(room) - room
    codes = np.full(int(room.sum()) + SPAN, _END, np.uint8)
    codes[at] = c
    codes[at[end] + SPAN] = 0
    words = np.flatnonzero((codes[:-1] == 0) & (codes[1:] != 0) & (codes[1:] != _END))
    closes = np.flatnonzero((codes[:-1] == 0) & (codes[1:] == _END)) + 1
    if not len(words):
        return Spans(codes, words, words, words)
    own = np.searchsorted(closes, words, side="right")  # the sentence of each word
    last = closes[own]
    begins = np.concatenate(([True], own[1:] != own[:-1]))
    nth = np.arange(len(words)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    ahead = np.concatenate((words[WORDS:], np.full(min(WORDS, len(words)), 1 << 60)))
    same = np.concatenate((own[WORDS:] == own[:-WORDS], np.zeros(min(WORDS, len(words)), bool)))
    ends = np.where(same, ahead, last)
    whole = np.concatenate((own[WORDS - 1 :] == own[: len(own) - WORDS + 1], np.zeros(min(WORDS - 1, len(words)), bool)))
    taken = whole | (nth == 0)  # a sentence of fewer words is one span
    of = np.minimum(np.searchsorted(at, words[taken] + 1, side="right") - 1, len(owner) - 1)
    return Spans(codes, words[taken], ends[taken], owner[of])


def _tuples(codes: np.ndarray, n: int):
    """(table positions, weight) of the tuples that start at the first n places, one shape at a time."""
    c = codes.astype(np.int32)
    for offsets in _OFFSETS:
        x = c[:n]
        for d in offsets[1:]:
            x = x * _CLASSES + c[d : n + d]
        yield x + _BASE[len(offsets)], DECAY ** (offsets[-1] - len(offsets) + 1)


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each tuple; those with an end mark weigh nothing
    bias: float
    cut: float = 0.0  # the value that scores 0.3
    slope: float = 4.0

    def values(self, s: Spans) -> np.ndarray:
        """The machine's value of each span."""
        if not len(s.starts):
            return np.zeros(0)
        n = len(s.codes) - SPAN
        v = np.zeros(n + 1)
        for at, weight in _tuples(s.codes, n):
            v[1:] += np.float32(weight) * self.table[at]
        total = np.cumsum(v)
        return (total[s.ends] - total[s.starts]) / np.sqrt(s.ends - s.starts) + self.bias

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """The highest span value of each whole text (the bias, if it has no span), a bounded block of characters at a time."""
        out = np.full(len(texts), -np.inf)
        block, owner, held = [], [], 0

        def flush() -> None:
            nonlocal block, owner, held
            if block:
                s = spans(block)
                np.maximum.at(out, np.array(owner)[s.owner], self.values(s))
            block, owner, held = [], [], 0

        for i, text in enumerate(texts):
            text = text or ""
            for part in _parts(text):
                block.append(part)
                owner.append(i)
                held += len(part)
                if held >= _BLOCK:
                    flush()
        flush()
        return np.where(np.isneginf(out), self.bias, out)

    def score(self, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.asarray(value) - self.cut) + np.log(0.3 / 0.7), -40, 40)))


def _parts(text: str):
    """A text in pieces of ``_BLOCK`` characters that begin at white space and overlap, so that no span is lost."""
    at = 0
    while len(text) - at > _BLOCK:
        yield text[at : at + _BLOCK]
        back = max(text.rfind(c, at + 1, at + _BLOCK - _OVERLAP) for c in " \n")
        at = back if back > at + _BLOCK // 2 else at + _BLOCK - _OVERLAP
    yield text[at:]


def _features(codes: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Table positions and weights of the tuples of one span, scaled by the root of its length."""
    n = end - start
    own = codes[start : end + SPAN]
    at, w = zip(*_tuples(own, n))
    free = [~((own[:n] == _END) | np.logical_or.reduce([own[d : n + d] == _END for d in o[1:]])) for o in _OFFSETS]
    return np.concatenate([x[f] for x, f in zip(at, free)]), np.concatenate([np.full(np.count_nonzero(f), y) for y, f in zip(w, free)]) / np.sqrt(n)


def kernel(a: str, b: str) -> float:
    """The kernel of two texts of one span each."""
    total: dict[int, float] = {}
    (x, y) = ((_features(s.codes, int(s.starts[0]), int(s.ends[0]))) for s in (spans([a]), spans([b])))
    for k, w in zip(*x):
        total[int(k)] = total.get(int(k), 0.0) + w
    return float(sum(total.get(int(k), 0.0) * w for k, w in zip(*y)))


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge SVM, by Newton steps on the active set; the last column of ``x`` is 1."""
    v = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ v) < 1
        square, side = ridge * np.eye(x.shape[1]), np.zeros(x.shape[1])
        for i in range(0, len(x), _ROWS):  # no copy of all active rows
            of = slice(i, i + _ROWS)
            own = x[of][active[of]]
            heavy = (own * weight[of][active[of], None]).T
            square += heavy @ own
            side += heavy @ y[of][active[of]]
        new = np.linalg.solve(square, side)
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v


def _without_ends(table: np.ndarray) -> np.ndarray:
    three, four = table[: _BASE[4]].reshape((_CLASSES,) * 3), table[_BASE[4] :].reshape((_CLASSES,) * 4)
    for t in (three, four):
        for axis in range(t.ndim):
            t[(slice(None),) * axis + (_END,)] = 0
    return table


def _first_table(bad: list[Spans], good: list[Spans]) -> np.ndarray:
    """Log odds of four-character tuples, by documents that have them, times the root of their number; none below 0."""

    def counts(docs: list[Spans]) -> np.ndarray:
        n = np.zeros(_SIZE, np.float32)
        for d in docs:
            size = len(d.codes) - SPAN
            n[np.unique(np.concatenate([at for (at, _), o in zip(_tuples(d.codes, size), _OFFSETS) if len(o) == 4]))] += 1
        return n

    b, g = counts(bad), counts(good)
    table, often = np.zeros(_SIZE, np.float32), np.flatnonzero(b > 1)
    b, g = b[often], g[often]
    odds = np.log((b + 0.5) / (len(bad) + 1)) - np.log((g + 0.5) / (len(good) + 1))
    table[often] = np.where(odds > 0, odds * np.sqrt(b), 0)
    return _without_ends(table)


Example = tuple[np.ndarray, int, int, float]  # codes, start, end, value


def _best(docs: list[Spans], model: ToxicityModel, most: int, above: float = -np.inf) -> list[Example]:
    """The ``most`` highest spans of each document that are above a value."""
    out = []
    for d in docs:
        v = model.values(d)
        out += [(d.codes, int(d.starts[i]), int(d.ends[i]), float(v[i])) for i in np.argsort(-v, kind="stable")[:most] if v[i] > above]
    return out


def _machine(positive: list[Example], negative: list[Example], hard: list[Example], landmarks: int, ridge: float, rng) -> ToxicityModel:
    """Nyström features from landmarks of all three kinds, then the SVM, collapsed to a table."""
    pick = lambda x, n: [x[i] for i in rng.permutation(len(x))[:n]]
    marks = pick(positive, landmarks // 2) + pick(hard, landmarks // 4)
    marks += pick(negative, landmarks - len(marks))
    found = [_features(*m[:3]) for m in marks]
    # the landmarks' features by column, as entries (column, landmark, weight): few of all pairs have one
    columns, place = np.unique(np.concatenate([at for at, _ in found]), return_inverse=True)
    own = np.repeat(np.arange(len(marks)), [len(at) for at, _ in found])
    entries, same = np.unique(place * len(marks) + own, return_inverse=True)
    held = np.bincount(same, np.concatenate([w for _, w in found]))
    column, mark = np.divmod(entries, len(marks))
    first = np.searchsorted(column, np.arange(len(columns) + 1))

    def kernels(at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of one span with every landmark."""
        c = np.minimum(np.searchsorted(columns, at), len(columns) - 1)
        shared = columns[c] == at
        c, w = c[shared], w[shared]
        n = first[c + 1] - first[c]
        e = np.arange(n.sum()) + np.repeat(first[c] - (np.cumsum(n) - n), n)
        return np.bincount(mark[e], np.repeat(w, n) * held[e], len(marks))

    value, vector = np.linalg.eigh(np.array([kernels(*f) for f in found]))
    kept = value > 1e-5 * value[-1]
    root = vector[:, kept] / np.sqrt(value[kept])
    examples = positive + negative + hard
    y = np.array([1.0] * len(positive) + [-1.0] * (len(negative) + len(hard)))
    x = np.ones((len(examples), root.shape[1] + 1))
    for i in range(0, len(examples), _ROWS):
        x[i : i + _ROWS, :-1] = np.array([kernels(*_features(*e[:3])) for e in examples[i : i + _ROWS]]) @ root
    weight = np.where(y > 0, 500 / len(positive), 500 / max(1, len(negative) + len(hard)))
    v = _fit_svm(x, y, weight, ridge)
    table = np.zeros(_SIZE, np.float32)
    table[columns] = np.bincount(column, held * (root @ v[:-1])[mark])
    return ToxicityModel(_without_ends(table), float(v[-1]))


def train(good: list[Spans], bad: list[Spans], *, landmarks: int = 512, ridge: float = 0.1, rounds: int = 4, negatives: int = 4000, hard_most: int = 4000, clean_above: float = 0.015, seed: int = 0) -> ToxicityModel:
    """Train on the spans of clean and of toxic documents; with one class only, scores are constant.

    ``negatives`` spans of clean documents are drawn, and up to ``hard_most`` of the highest valued
    ones join them.  A quarter of the clean documents (if there are 40 or more) is not trained on and sets
    where scores reach 0.3: ``clean_above`` of them are above it.
    """
    good, bad = [g for g in good if len(g.starts)], [b for b in bad if len(b.starts)]
    if not bad or not good:
        return ToxicityModel(np.zeros(_SIZE, np.float32), 1.0 if bad else -1.0, 0.0, 40.0)
    judge = good[::4] if len(good) >= 40 else good
    if len(good) >= 40:
        good = [g for i, g in enumerate(good) if i % 4]
    rng = np.random.default_rng(seed)
    each = -(-negatives // len(good))
    negative = [(g.codes, int(g.starts[i]), int(g.ends[i]), 0.0) for g in good for i in rng.permutation(len(g.starts))[:each]]
    model, hard = ToxicityModel(_first_table(bad, good), 0.0), []
    for _ in range(rounds):
        model = _machine(_best(bad, model, 1), negative, hard, landmarks, ridge, rng)
        wrong = sorted(_best(good, model, 5, -0.5), key=lambda e: -e[3])
        hard = (wrong + hard)[:hard_most]
    tops = np.array([e[3] for e in _best(judge, model, 1)])
    model.cut = float(np.clip(np.quantile(tops, 1 - clean_above), -0.2, 0.3))
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 1500, longest: int = 20_000, **how) -> ToxicityModel:
    """Train on documents that are not held out and have a toxic label.

    Of each label about ``sample`` documents of at most ``longest`` characters are taken, drawn by hash of
    the doc_id (all, if there are fewer); these two parameters bound what comes to the driver (at most
    about 2 * sample * longest characters, cut into spans by the tasks).  Several labels of a document count as toxic if one is; a null
    label is none, and a row without a doc_id is not trained on.  Equal texts are taken once.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, sample / max(1, counts.get(0, 0)))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    ids = small_rows(known.where(draw < share), 4 * sample)
    if ids is None:
        raise ValueError("the hash drew far more documents than asked for")
    if not ids:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= longest).select("doc_id", "toxic", "text")

    def cut(batches: Batches) -> Batches:
        for b in batches:
            found = [spans([t]) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["toxic"], pa.array([s.codes.tobytes() for s in found], pa.binary()), pa.array([s.starts.astype(np.int32).tobytes() for s in found], pa.binary()), pa.array([s.ends.astype(np.int32).tobytes() for s in found], pa.binary())],
                ["doc_id", "toxic", "codes", "starts", "ends"],
            )

    got = rows.mapInArrow(cut, "doc_id long, toxic int, codes binary, starts binary, ends binary").dropDuplicates(["toxic", "codes"]).collect()
    kinds: tuple[list[Spans], list[Spans]] = ([], [])
    for r in sorted(got, key=lambda r: (r["codes"], r["toxic"])):
        starts, ends = (np.frombuffer(r[k], np.int32).astype(np.int64) for k in ("starts", "ends"))
        kinds[r["toxic"]].append(Spans(np.frombuffer(r["codes"], np.uint8), starts, ends, np.zeros(len(starts), np.int64)))
    return train(*kinds, **how)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` (with text) and toxicity_score (0 to 1) and toxic_predicted of each whole text.

    Null and empty texts, and those without a letter or digit, score as the machine's bias.  Columns of
    these two names are replaced.
    """
    docs = docs.drop("toxicity_score", "toxic_predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(sent.value.score(sent.value.of_texts(texts.tolist())))

    return docs.withColumn("toxicity_score", score("text")).withColumn("toxic_predicted", (F.col("toxicity_score") >= threshold).cast("int"))
