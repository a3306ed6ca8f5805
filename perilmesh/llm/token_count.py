"""Token counts by finite-state transduction.

A byte-pair vocabulary with word ends is compiled, as far as the texts need it,
into a deterministic transducer over the symbols of a word.  Each transition
carries the signed change of the number of tokens, so that the sum along a
word's path is the library's token count of that word.

Why this is exact: the greedy encoding of a word has the property that its
prefixes are the greedy encodings of the corresponding prefixes of the word.
So each prefix has one *last token*, and a token ``t`` is the last token of a
prefix exactly if it ends there and may follow the last token of what lies
before it (the pair encodes to itself).  To step on, it is enough to know the
last tokens at those positions from which a vocabulary entry may still be under
way; that, as a tuple, is the state.

Long texts are cut into chunks that become rows of their own.  A cut is made at white space or
between two pieces, where the transducer is in its start state, or, in an unbroken run of one kind of
character, anywhere in it.  A chunk's map takes each state that may be live at its start to the state
at its end and the change of the count; the live states of a cut inside a run are found by running the
transducer over the characters before it from each of their positions.  Maps compose associatively
(``compose``) and are combined in a tree over chunk numbers by Spark.  Should a map lack the state that the chunk
before it ends in, that document's chunks are run through in order by one task.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, staged

#: White space as the tokenizer's patterns have it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_END = 0x1000  # added to the code of a symbol that ends a word
_STATES, _WORDS = 150_000, 300_000  # bounds of the tables a worker keeps
_LONG = 256  # strings of more characters are not kept
_AHEAD, _BEFORE = 1024, 96  # characters after a nominal cut to find a good one in; characters run through to find live states
_SINGLE = (-1, "", "")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Transducer:
    """Lazily compiled transducer of one vocabulary file (tokenizers' .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
            raise ValueError("only BPE vocabularies with the word end </w> are supported")
        self.symbols = _byte_symbols()
        self.tokens = {self._packed(t) for t in model["vocab"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self._packed(a), self._packed(b)): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        self.under_way = {t[:i] for t in self.tokens for i in range(1, len(t))}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.words: dict[str, int] = {}
        self.heard: dict[str, int] = {}
        self._reset()

    @staticmethod
    def _packed(token: str) -> str:
        return token[:-5] + chr(ord(token[-5]) + _END) if token.endswith("</w>") and len(token) > 4 else token

    def _reset(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = {("", (None,)): 0}
        self.states = [("", (None,), (0,))]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` side by side encode to themselves.

        They do unless a merge across their border comes first.  The border is
        followed back in time: the merge that made the later of the two symbols
        beside it is undone, down to single symbols.  A merge across it, of rank
        r, happens if r is below the rank that consumes the left symbol and not
        above the one that consumes the right symbol (ties go to the left).
        """
        found = self.pairs.get((left, right))
        if found is None:
            a, b, a_ends, b_ends, found = left, right, 1 << 60, 1 << 60, True
            while True:
                rank = self.ranks.get((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends:
                    found = False
                    break
                (a_made, _, a_right), (b_made, b_left, _) = self.made.get(a, _SINGLE), self.made.get(b, _SINGLE)
                if a_made < 0 and b_made < 0:
                    break
                if a_made > b_made:
                    a, a_ends = a_right, a_made
                else:
                    b, b_ends = b_left, b_made
            self.pairs[left, right] = found
        return found

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """The transition from ``state`` on ``symbol``: next state and change of the count.

        A state holds the longest string under way, and for each position in it
        from which an entry is under way the last token there and the count
        there less the current count.
        """
        trail, lasts, counts = self.states[state]
        text = trail + symbol
        token, change = None, 0
        for i, last in enumerate(lasts):
            t = text[i:]
            if last != "" and t in self.tokens and (last is None or self._may_follow(last, t)):
                token, change = t, counts[i] + 1
                break
        if token is None:
            raise ValueError(f"the vocabulary has no entry for {symbol!r}")
        # "" marks a position from which nothing is under way any more
        alive = [text[i:] in self.under_way for i in range(len(text))]
        start = alive.index(True) if True in alive else len(text)
        lasts = (*(lasts[i] if i < len(alive) and alive[i] else "" for i in range(start, len(text))), token)
        counts = (*(counts[i] - change if alive[i] else 0 for i in range(start, len(text))), 0)
        key = (text[start:], lasts, counts)
        after = self.known.get(key)
        if after is None:
            after = self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][symbol] = after, change
        return after, change

    def run(self, state: int, text: str, ends: bool) -> tuple[int, int]:
        """State and change of the count after the symbols of ``text``, the last of which ends a piece or not."""
        symbols = [self.symbols[b] for b in text.encode()]
        if ends and symbols:
            symbols[-1] = chr(ord(symbols[-1]) + _END)
        n = 0
        for s in symbols:
            step = self.steps[state].get(s) or self._compile(state, s)
            state = step[0]
            n += step[1]
        return state, n

    def piece(self, piece: str) -> int:
        """Tokens of one piece of the pre-tokenizer."""
        found = self.heard.get(piece)
        if found is None:
            found = self.run(0, piece, True)[1]
            if len(self.states) > _STATES:
                self._reset()
            if len(self.heard) >= _WORDS:
                self.heard.clear()
            if len(piece) <= _LONG:
                self.heard[piece] = found
        return found

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, character by character (no final sigma)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word(self, word: str) -> int:
        """Tokens of a normalised string without white space."""
        found = sum(self.piece(m.group()) for m in self.pieces.finditer(word))
        if len(self.words) >= _WORDS:
            self.words.clear()
        if len(word) <= _LONG:
            self.words[word] = found
        return found

    def text(self, text: str) -> int:
        if self.special and "<" in text and len(parts := self.special.split(text)) > 1:
            return len(parts) // 2 + sum(self.text(p) for p in parts[::2])
        return self._count(self.normal(text))

    def _count(self, text: str) -> int:
        """Tokens of a normalised text without special ones."""
        words = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        known, word = self.words.get, self.word
        n = 0
        for w in words:
            k = known(w)
            n += word(w) if k is None else k
        return n

    # ------------------------------------------------------------ chunks of long texts

    def _kind(self, c: str) -> str:
        """letter, digit or other for a character that stays one when normalised, else mixed."""
        own = self.normal(c)
        if len(own) != 1 or unicodedata.combining(c):
            return "mixed"
        return "letter" if _LETTERS.match(own) else "digit" if _DIGIT.match(own) else "other"

    def cuts(self, text: str, size: int) -> list[tuple[int, bool]]:
        """(start, inside) of the chunks of about ``size`` characters; inside: the cut is in a run of one kind."""
        out, at = [(0, False)], size
        while at < len(text):
            to = min(len(text), at + _AHEAD)
            found = _SPACES.search(text, at, to)
            place = (found.start(), False) if found else self._between(text, at, to)
            if place is None:
                at = to
                continue
            out.append(place)
            at = place[0] + size
        return out

    def _between(self, text: str, at: int, to: int) -> tuple[int, bool] | None:
        """A cut in text without white space: between pieces, or else in a run of letters or others longer than the states need."""
        special = [m.span() for m in self.special.finditer(text, max(0, at - 64), min(len(text), to + 64))] if self.special else []
        kinds = [self._kind(c) for c in text[at - 1 : to]]
        free = lambda p: not any(a < p < b for a, b in special) and _apart(text, p)
        for p in range(at, to):
            a, b = kinds[p - at : p - at + 2]
            if "mixed" not in (a, b) and (a != b or a == "digit") and "'" not in text[max(0, p - 3) : p + 3] and free(p):
                return p, False
        if to - at < _AHEAD or special or len(set(kinds)) > 1:
            return None
        return next(((p, True) for p in range((at + to) // 2, to) if free(p)), None)

    def live(self, before: str) -> set[int]:
        """The states that may be live behind ``before``, a piece having begun at any of its positions (or before)."""
        own = self.normal(before)
        return {self.run(0, own[i:], False)[0] for i in range(len(own))}

    def chunk(self, text: str, before: str | None, goes_on: bool) -> list[tuple[str, str, int]]:
        """Map of a chunk: (state at its start, state at its end, change of the count), states as text.

        ``before`` is what comes before a cut inside a run (else None); ``goes_on`` says that its end is one, too.
        """
        parts = self.special.split(text) if self.special else [text]
        own = [self.normal(p) for p in parts[::2]]
        head = begun = ""
        if before is not None:
            head = (_LETTERS.match(own[0]) or _OTHERS.match(own[0])).group()
            own[0] = own[0][len(head) :]
        through = goes_on and len(own) == 1 and not own[0]  # the piece under way goes on behind the chunk
        if goes_on and not through:
            *_, last = self.pieces.finditer(_SPACES.split(own[-1])[-1])
            begun = last.group()
            own[-1] = own[-1][: len(own[-1]) - len(begun)]
        middle = len(parts) // 2 + sum(map(self._count, own))
        out = []
        for state in self.live(before) if before is not None else {0}:
            entry, (after, n) = self.named(state), self.run(state, head, not through)
            if not through:
                after, more = self.run(0, begun, False) if goes_on else (0, 0)
                n += middle + more
            out.append((entry, self.named(after), n))
        return out

    def named(self, state: int) -> str:
        """A state as text that another worker understands."""
        return json.dumps(self.states[state])

    def state(self, name: str) -> int:
        """The state of a name, made known if it is not."""
        trail, lasts, counts = json.loads(name)
        key = (trail, tuple(lasts), tuple(counts))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.known[key]


def compose(maps: list[list[tuple[str, str, int]]]) -> list[tuple[str, str, int]]:
    """The map of neighbouring chunks from theirs; associative.  Entries whose way leads out of a map are left out."""
    out = maps[0]
    for m in maps[1:]:
        step = {entry: (after, n) for entry, after, n in m}
        out = [(entry, step[after][0], n + step[after][1]) for entry, after, n in out if after in step]
    return out


_START = json.dumps(("", (None,), (0,)))
_LETTERS, _DIGIT, _OTHERS = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}"), regex.compile(r"[^\s\p{L}\p{N}]+")


def _apart(text: str, p: int) -> bool:
    """Whether the characters around position p are normalised as they are together."""
    a, b = text[max(0, p - 8) : p], text[p : p + 8]
    return (a.isascii() and b.isascii()) or unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One compiled transducer for each worker and vocabulary."""
    return Transducer(path)


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 2048, chunk_chars: int = 1 << 15, fan: int = 16) -> DataFrame:
    """Exact token counts of ``docs`` (doc_id, text; other columns are ignored).

    ``vocabulary`` is the path of a vocabulary file that all executors have.
    Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: no bytes, no tokens.  Repeated rows each give
    a row; a null doc_id stays null.  An empty table gives an empty result.
    Texts of more than ``chunk_chars`` code points are cut into chunks, which are dealt to all tasks; only these move,
    and their maps are combined ``fan`` at a time.
    """
    schema = "uid long, doc_id long, n_bytes long, n_tokens long, i int, last int, before string, goes_on boolean, part string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def counted(batches: Batches) -> Batches:
        t = transducer(vocabulary)
        for b in batches:
            rows, held = [], 0
            for uid, doc, text in zip(*(b[c].to_pylist() for c in ("uid", "doc_id", "text"))):
                text = text or ""
                size = len(text.encode())
                places = t.cuts(text, chunk_chars) if len(text) > chunk_chars else []
                if len(places) < 2:
                    rows.append((uid, doc, size, t.text(text), None, None, None, None, None))
                    continue
                for i, (at, inside) in enumerate(places):
                    end, goes_on = places[i + 1] if i + 1 < len(places) else (len(text), False)
                    rows.append((uid, doc, size, None, i, len(places) - 1, text[max(0, at - _BEFORE) : at] if inside else None, goes_on, text[at:end]))
                    held += end - at
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    first = staged(numbered.mapInArrow(counted, schema), "tokens")
    done = first.where("i IS NULL").select("doc_id", "n_bytes", "n_tokens")
    chunks = first.where("i IS NOT NULL")
    known = chunks.where("i = 0").select("uid", "doc_id", "n_bytes", "last")
    most = known.agg(F.max("last")).first()[0]
    if most is not None:
        done = done.unionByName(_combined(chunks, known, vocabulary, most + 1, fan))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_MAP = "array<struct<entry:string,after:string,n:bigint>>"
_ENTRIES = pa.list_(pa.struct([("entry", pa.string()), ("after", pa.string()), ("n", pa.int64())]))


def _combined(chunks: DataFrame, known: DataFrame, vocabulary: str, most: int, fan: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the texts that were cut into up to ``most`` chunks."""

    def entries(m) -> list[dict]:
        return [{"entry": e, "after": a, "n": n} for e, a, n in m]

    def mapped(batches: Batches) -> Batches:
        t = transducer(vocabulary)
        for b in batches:
            found = [entries(t.chunk(*r)) for r in zip(*(b[c].to_pylist() for c in ("part", "before", "goes_on")))]
            yield pa.RecordBatch.from_arrays([b["uid"], b["i"], pa.array(found, _ENTRIES)], ["uid", "i", "map"])

    def joined(batches: Batches) -> Batches:
        for b in batches:
            found = []
            for rows in b["maps"].to_pylist():
                found.append(entries(compose([[(e["entry"], e["after"], e["n"]) for e in r["map"]] for r in rows])))
            yield pa.RecordBatch.from_arrays([b["uid"], b["i"], pa.array(found, _ENTRIES)], ["uid", "i", "map"])

    parts = chunks.select("uid", "i", "before", "goes_on", "part").repartition("uid", "i")
    maps = staged(parts.mapInArrow(mapped, f"uid long, i int, map {_MAP}"), "maps")
    while most > 1:
        groups = maps.groupBy("uid", F.floor(F.col("i") / fan).cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "map"))).alias("maps"))
        maps = staged(groups.mapInArrow(joined, f"uid long, i int, map {_MAP}"), "maps")
        most = -(-most // fan)
    whole = known.join(maps, "uid", "left").withColumn("n_tokens", F.expr(f"get(filter(map, e -> e.entry = '{_START}'), 0).n"))
    lost = whole.where("n_tokens IS NULL").select("uid")
    found = whole.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")
    if lost.isEmpty():
        return found

    def through(batches: Batches) -> Batches:
        t, at, state, n = transducer(vocabulary), None, 0, 0
        for b in batches:
            out = []
            for uid, text, before, goes_on in zip(*(b[c].to_pylist() for c in ("uid", "part", "before", "goes_on"))):
                if uid != at:
                    if at is not None:
                        out.append((at, n))
                    at, state, n = uid, 0, 0
                name = t.named(state)
                t.live = lambda _, name=name: {t.state(name)}
                ((_, after, more),) = t.chunk(text, before, goes_on)
                del t.live
                state, n = t.state(after), n + more
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["uid", "n_tokens"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64())], ["uid", "n_tokens"])

    again = chunks.join(lost, "uid", "left_semi").select("uid", "i", "part", "before", "goes_on").repartition("uid").sortWithinPartitions("uid", "i").mapInArrow(through, "uid long, n_tokens long")
    return found.unionByName(known.join(again, "uid").select("doc_id", "n_bytes", "n_tokens"))
