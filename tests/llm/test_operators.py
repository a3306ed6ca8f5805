"""Small tests of the text operators: plain versions beside them, and rows that are odd."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long"
ODD = [
    (1, None, None, None, None, 1),
    (2, "", "en", "a", 0, 2),
    (3, "one two three four five six. Seven eight.\nA line that repeats here\n  a LINE that repeats here\t", "en", "a", 9, 3),
    (3, "one two three four five six. Seven eight.\nA line that repeats here\n  a LINE that repeats here\t", "en", "a", 9, 3),
    (4, "A line that repeats here\nshort\nshort", "fr", "b", 9, 4),
    (None, "A line that repeats here\nété naïve ΣΑΣ <|endoftext|>", "fr", None, 9, 5),
    (6, "word " * 30_000, "en", "b", 150_000, 6),
    (7, "!!! ...", None, "c", 7, 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def linked(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# ------------------------------------------------------------- 1 warc


def test_warc_round_trip_and_odd_rows(spark, tmp_path):
    from perilmesh.llm.warc import digest, page_of, read_archives, write_archives

    rows = [(1, "u", "a"), (2, "v", "a"), (2, "v", "a"), (None, "w", "a"), (5, None, None), (6, "x\r\ny", ""), (7, "z", "é" * 100_000)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, payload string"), f"file://{tmp_path}/w", records_per_file=2)
    got = read_archives(spark, f"file://{tmp_path}/w").withColumn("page", page_of("record_id")).withColumn("to", page_of("refers_to")).collect()
    assert not [r for r in got if r.gap_reason]
    kinds = Counter((r.page, r.record_type, r.to, r.payload_bytes, r.payload_digest) for r in got)
    a, e = digest(b"a"), digest(b"")
    assert kinds == Counter({(1, "response", None, 1, a): 1, (2, "revisit", 1, 1, a): 2, (None, "revisit", 1, 1, a): 1, (5, "response", None, 0, e): 1, (6, "revisit", 5, 0, e): 1, (7, "response", None, 200_000, digest("é".encode() * 100_000)): 1})


def test_warc_least_bytes_and_empty_table(spark, tmp_path):
    from perilmesh.llm.warc import read_archives, write_archives

    rows = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "x"), (4, "y", "x")], "page_id long, url string, payload string")
    write_archives(rows, f"file://{tmp_path}/w", least_bytes=2)
    assert Counter(r.record_type for r in read_archives(spark, f"file://{tmp_path}/w").collect()) == {"response": 3, "revisit": 1}
    write_archives(rows.limit(0), f"file://{tmp_path}/e")
    assert read_archives(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    from perilmesh.llm.warc import members, record, salvage

    rng = random.Random(7)
    parts = [record(i, f"http://x/{i}", b"<p>%d</p>" % i * 40, None) for i in range(20)]
    raw = b"".join(members(p) if zipped else p for p in parts)
    assert [x[3] for x in salvage(raw)] == [None] * 20
    for _ in range(60):
        at = rng.randrange(len(raw))
        hurt = bytearray(raw)
        hurt[at : at + rng.randrange(1, 400)] = b""
        out = list(salvage(bytes(hurt)))
        assert sum(x[2] is not None for x in out) >= 17
        assert out[0][0] == 0 and out[-1][1] == len(hurt) and all(a[1] == b[0] for a, b in zip(out, out[1:]))
    assert [(x[0], x[1]) for x in salvage(b"junk" * 5)] == [(0, 20)] and not list(salvage(b""))


# ------------------------------------------------------------- 2 token counts


def _library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_counts_equal_the_library(spark, odd, none, sf):
    from perilmesh.llm.token_count import token_counts

    path, library = _library()
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    for docs, size in ((spark.read.parquet(f"{sf}/documents.parquet"), 500), (odd, 11), (odd, 1 << 18)):
        want = Counter((r.doc_id, len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in docs.collect())
        got = Counter(tuple(r) for r in token_counts(docs, path, chunk_chars=size, fan=3).collect())
        assert got == want
    assert token_counts(none, path).count() == 0


@pytest.mark.parametrize("live", [True, False])
def test_token_counts_of_unbroken_texts(spark, live, monkeypatch):
    """Cuts inside runs: maps of several live states; and the way in order where a map lacks the state."""
    import perilmesh.llm.token_count as T

    path, library = _library()
    if not live:
        monkeypatch.setattr(T, "_BEFORE", 1)
    rng = random.Random(4)
    texts = ["a" * 30_000, "ab" * 9000 + "'s" + "lo" * 5000, "=" * 15_000, "e\u0301" * 4000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "x " + "haha" * 4000 + " <|endoftext|>" + "!?" * 3000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_tokens for r in T.token_counts(frame, path, chunk_chars=2000, fan=4).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_maps_compose_associatively():
    import perilmesh.llm.token_count as T

    path, library = _library()
    t, text = T.Transducer(path), "banana" * 3000
    places = t.cuts(text, 1500)
    ends = [*places[1:], (len(text), False)]
    maps = [t.chunk(text[a:b], text[max(0, a - T._BEFORE) : a] if inside else None, on) for (a, inside), (b, on) in zip(places, ends)]
    assert len(maps) > 5 and max(map(len, maps)) > 1
    left = maps[0]
    for m in maps[1:]:
        left = T.compose([left, m])
    right = maps[-1]
    for m in maps[-2::-1]:
        right = T.compose([m, right])
    assert left == right == T.compose(maps) and left[0][2] == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_strings():
    from perilmesh.llm.token_count import Transducer

    path, library = _library()
    t = Transducer(path)
    rng = random.Random(3)
    alphabet = "aabcdeinorst  '.!,<|>éßΣİK1２日本👩́‍\x1c "
    for text in ["Hello WORLD's <|endoftext|>x<|startoftext|>", "a" * 400, "don't'd's 12½", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400))]:
        assert t.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


# ------------------------------------------------------------- 3 language


def test_language_identification(spark, odd, none, sf, monkeypatch):
    import perilmesh.llm.language_id as L
    from perilmesh.llm.common import held_out
    from perilmesh.llm.language_id import fit_profiles, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = fit_profiles(docs)
    rows = identify(docs, profiles).join(docs.select("doc_id", "lang", held_out().alias("h")), "doc_id").where("h").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in identify(odd, profiles).collect()}
    assert len(got) == 7 and got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[7].score == 0
    assert fit_profiles(none) == [] and identify(none, profiles).count() == 0 and {r.lang_pred for r in identify(odd, []).collect()} == {"und"}
    monkeypatch.setattr(L, "MOST_ENTRIES", 300)  # a language at a time
    apart = fit_profiles(docs)
    assert len(apart) == len(profiles[0].languages) and sorted(identify(docs, apart).collect()) == sorted(identify(docs, profiles).collect())


def test_out_of_place_distance():
    from perilmesh.llm.language_id import Profiles, ngrams

    def plain(text, profile, length):
        grams, counts = ngrams(text)
        own = [g for _, g in sorted((-n, g) for g, n in zip(grams.tolist(), counts.tolist()))][:length]
        return sum(abs(profile.index(g) - i) if g in profile else length for i, g in enumerate(own)), len(own)

    profiles = {}
    for lang, text in (("x", "the cat sat on the mat " * 3), ("y", "le chat est sur le tapis " * 3)):
        grams, counts = ngrams(text)
        profiles[lang] = [g for _, g in sorted((-n, g) for g, n in zip(grams.tolist(), counts.tolist()))][:20]
    model = Profiles([(k, i, g) for k, v in profiles.items() for i, g in enumerate(v)], 20)
    for text in ("the hat", "sur le toit", "zzz", "q"):
        far = {k: plain(text, v, 20)[0] for k, v in profiles.items()}
        best = min(sorted(far), key=far.get)
        second = sorted(far.values())[1]
        assert model.predict(text) == (best, pytest.approx((second - far[best]) / second))


# ------------------------------------------------------------- 4 decontamination


def _plain_hits(docs, items, window):
    from perilmesh.llm.decontaminate import words_of

    out = {}
    for i, text in docs:
        words, hit, found = words_of((text or "").encode()), set(), set()
        for item, t in items:
            own = words_of((t or "").encode())
            for s in range(max(1, len(own) - window + 1)) if own else ():
                w = own[s : s + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(item))
        out[i] = (len(words), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def test_contamination_against_plain_search(spark, none):
    from perilmesh.llm.decontaminate import contamination

    rng = random.Random(5)
    word = lambda: rng.choice("a b c d e f Gg été".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(25)] + [(90, None), (91, "gg"), (92, "a a a a a a")]
    docs = [(i, "-".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 40)]
    for i in range(0, 60, 7):
        docs[i] = (i, docs[i][1] + " " + (items[i % 25][1] or "") + ", " + docs[i][1])
    frame = spark.createDataFrame([(i, t, "x", "x") for i, t in docs], "doc_id long, text string, word string, item_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in contamination(frame, spark.createDataFrame(items, "item_id long, text string"), window=4).collect()}
    assert got == _plain_hits(docs, items, 4)
    assert contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert all(r.n_hit == 0 for r in contamination(frame, spark.createDataFrame([], "item_id long, text string")).collect())


def test_index_without_a_small_word_set(spark, monkeypatch):
    from perilmesh.llm import decontaminate as D

    monkeypatch.setattr(D, "MOST_WORDS", 1)
    docs, items = [(1, "x a b c d y"), (2, "a b c"), (3, "q")], [(7, "a b c d")]
    got = {r.doc_id: r.n_hit for r in D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=3).collect()}
    assert got == {1: 4, 2: 3, 3: 0}


def test_rows_of_one_id_are_kept_apart(spark):
    from perilmesh.llm.decontaminate import contamination

    docs = spark.createDataFrame([(1, "a b x x"), (1, "x x c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = {r.doc_id: r.n_hit for r in contamination(docs, spark.createDataFrame([(7, "a b c d")], "item_id long, text string"), window=4).collect()}
    assert got == {1: 0, 2: 4, None: 4}


def test_proximity(spark):
    from perilmesh.llm.decontaminate import contamination, proximity_matches

    docs = spark.createDataFrame([(1, "red x x blue x x x red"), (2, "blue red"), (3, None), (4, "red x x x x blue")], "doc_id long, text string")
    pairs = spark.createDataFrame([("red", "blue"), ("red", "red"), (None, "x")], "a string, b string")
    got = sorted((r.doc_id, r.a, r.b, r.pos_a, r.pos_b) for r in proximity_matches(docs, pairs, 4).collect())
    assert got == [(1, "red", "blue", 0, 3), (2, "red", "blue", 1, 0)]
    near = contamination(docs, spark.createDataFrame([(7, "red blue"), (8, "x"), (9, "green red")], "item_id long, text string"), window=4, proximity=True).collect()
    assert {r.doc_id: r.n_near for r in near} == {1: 1, 2: 1, 3: 0, 4: 0}


# ------------------------------------------------------------- 5 mixing


def test_mixing_targets_and_copies(spark, odd, none):
    from perilmesh.llm.mixing import mix, repeated, source_targets

    rng = random.Random(1)
    for _ in range(5):
        sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(9)} | {None: 300}
        names = sorted((k for k in sizes if k), key=lambda k: k.encode()) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        total, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
        while True:  # what exceeds a cap is shared again
            rest = total - sum(target.values())
            share = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
            over = [k for k in open_ if share[k] > 2 * sizes[k]]
            if not over:
                target |= share
                break
            for k in over:
                target[k] = 2 * sizes[k]
                open_.discard(k)
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r.source: r.target for r in source_targets(frame, (5, 2, 1), 1.5, 2.0).collect()} == pytest.approx(target)
    docs = [(i, f"s{i % 3}", rng.randrange(50)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, words long")
    want = mix(frame, size="words").collect()
    assert sorted(mix(frame.repartition(7), size="words").collect()) == sorted(want)
    unit = {r.doc_id: r.u for r in frame.selectExpr("doc_id", "cast(shiftrightunsigned(xxhash64(0, doc_id), 11) as double) * pow(2, -53) as u").collect()}
    for r in want:  # floor(rate) copies, and one more by the seeded draw
        assert r.copies == int(r.rate) + (unit[r.doc_id] < r.rate - int(r.rate)) and r.size == docs[r.doc_id][2]
    rows = mix(odd).collect()
    assert len(rows) == 8 and all(0 <= r.copies <= 2 for r in rows) and {r.doc_id: r.size for r in rows}[7] == 2
    assert sorted(map(str, rows)) == sorted(map(str, mix(odd).collect()))
    assert repeated(mix(odd)).count() == sum(r.copies for r in rows) and mix(none).count() == 0


# ------------------------------------------------------------- 6 version sketch


def test_versions_against_sets(spark, odd, none, sf):
    from perilmesh.llm.version_sketch import digests, edited, versions

    for docs, parts in ((spark.read.parquet(f"{sf}/documents.parquet"), 5), (odd, 3), (odd, 1), (odd.limit(1), 4)):
        rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
        want = Counter()
        for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
            new = edited(text, after)
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            want[i if i > -(1 << 63) else None, len(text), round(like(digests(text), digests(new)), 9), round(like(digests(text), digests(after)), 9)] += 1
        got = versions(docs, ranges=parts).collect()
        assert Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
        prints = defaultdict(set)
        for r in got:
            prints[r.doc_id].add(r.fingerprint)
        assert all(len(x) == 1 for x in prints.values())
    assert versions(none).count() == 0


def test_sketch_recovers_differences():
    from perilmesh.llm.version_sketch import Sketch, difference

    rng = random.Random(2)
    for n in (0, 1, 5, 60, 900):
        shared, a, b = ({rng.getrandbits(64) for _ in range(k)} for k in (300, n, n // 2))
        x, y = shared | a, shared | b
        assert difference(x, y, Sketch(8, x), Sketch(8, y)) == (a, b)


def test_cutting_is_by_content_at_every_size(sf):
    from perilmesh.llm.version_sketch import digests, edited

    rng = random.Random(8)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(40_000)]
    for n in (60, 330, 340, 5000, 40_000):  # no sentence ends; about 2000 characters lie between the second and the third
        text = " ".join(words[:n])
        assert like(digests(text), digests("Up front, " + text)) > 1 - 40 / n - 0.01
        assert like(digests(text), digests(text + " ab")) > 1 - 20 / n
        assert 0.25 < like(digests(text), digests(edited(text, " ".join(reversed(words))))) < 0.5
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    assert like(digests(run), digests("xy" + run)) > 0.97 and like(digests("ab " * 3000), digests("ab " * 1500)) > 0.45
    assert digests("") == digests(" \n") == set() and len(digests("ab. ab. ab.")) == 3
    known: dict = {}
    digests("One two three. Four five", known)
    assert digests("Four five\nOne two three", known) == digests("Four five\nOne two three")


# ------------------------------------------------------------- 7 simhash


@pytest.mark.parametrize("length", [63, 31])
def test_anchors_cover_all_close_pairs(length):
    from perilmesh.llm.simhash import anchors

    rng = random.Random(4)
    for _ in range(60):
        x = rng.getrandbits(length + 1)
        flips = [(), (rng.randrange(length + 1),), tuple(rng.sample(range(length + 1), 2)), (length, rng.randrange(length))]
        words = [x ^ sum(1 << f for f in own) for own in flips]
        found, owner = anchors(np.array(words, np.uint64), length)
        sets = [set(found[owner == i].tolist()) for i in range(4)]
        assert all(len(s) == np.count_nonzero(owner == i) <= 33 and all((a ^ words[i]).bit_count() <= 2 for a in s) for i, s in enumerate(sets))
        assert all(sets[0] & s for s in sets)


def test_near_duplicates_against_all_pairs(spark, odd, none, sf):
    from perilmesh.llm.simhash import fingerprint, near_duplicates

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for frame in (docs, odd):
        rows = [(r.doc_id, fingerprint((r.text or "").encode())) for r in frame.collect()]
        known = [(i, f) for i, f in rows if i is not None]
        want = linked({i for i, _ in known}, [(a, b) for a, x in known for b, y in known if a < b and (x ^ y).bit_count() <= 2])
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(frame).collect() if r.doc_id is not None)
        assert got == Counter((i, f"{f:016x}", want[i]) for i, f in known)
    assert near_duplicates(none).count() == 0


def test_bucket_forest_connects_chains():
    from perilmesh.llm.simhash import _forest

    fps = [0, 0b11, 0b1111, 0b111111, 0b111 << 40]
    assert len(set(linked(range(5), _forest(fps, list(range(5)), 2)).values())) == 2


def test_similar_documents(spark):
    from perilmesh.llm.simhash import near_duplicates

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, group = [], {}
    for g in range(30):
        base = [word() for _ in range(300)]
        for _ in range(3):
            own = list(base)
            for p in rng.sample(range(300), 4):  # about 0.87 of the shingles are shared with the base
                own[p] = word()
            group[len(docs)] = g
            docs.append((len(docs), " ".join(own if len(docs) % 3 else base)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.8).collect()}
    assert all(group[i] == group[c] for i, c in got.items())
    assert sum(c % 3 == 0 for c in got.values()) >= 0.9 * len(got)


def test_chains_of_near_copies_against_all_pairs(spark):
    """Groups of hundreds in which each text is similar to its neighbours only; ids in any order."""
    from perilmesh.llm.simhash import near_duplicates, shingle_hashes, wide_fingerprint

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in (250, 100):
        own = [word() for _ in range(300)]
        for _ in range(n):
            for p in rng.sample(range(300), 4):
                own[p] = word()
            texts.append(" ".join(own))
    rng.shuffle(texts)
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    wide = [[h >> at & (1 << 32) - 1 for h in wide_fingerprint(t.encode()) for at in (0, 32)] for t in texts]
    bits = lambda i, j: [(x ^ y).bit_count() for x, y in zip(wide[i], wide[j])]
    meet = [(i, j) for i, j in alike if min(bits(i, j)) <= 2 and sum(bits(i, j)) <= 26]
    assert len(meet) > 0.9 * len(alike)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=0.8).collect()}
    whole = linked(range(len(texts)), alike)
    assert [(i, j) for i, j in meet if got[i] != got[j]] == []
    assert all(whole[i] == whole[c] for i, c in got.items())


def test_similar_texts_in_blocks(spark):
    """A crowd at one anchor that is cut into blocks: versions of one text, each similar to it alone."""
    from perilmesh.llm.simhash import shingle_hashes, similar_links

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(80):
        own = list(base)
        for p in rng.sample(range(300), 5):
            own[p] = word()
        texts.append(" ".join(own))
    sets = [set(shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = [(i, j) for i in range(81) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) < 200
    found = similar_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()
    got, want = linked(range(81), [(r.a, r.b) for r in found]), linked(range(81), alike)
    assert all(want[i] == want[c] for i, c in got.items()) and sum(got[i] != c for i, c in want.items()) <= 4  # about one pair in twenty never meets


def test_similar_texts_of_an_equal_wide_hash(spark):
    """A passage repeated more or less often: the same words and pairs, so one 128-bit hash."""
    from perilmesh.llm.simhash import similar_links, wide_fingerprint

    p, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    texts = [" ".join((p, p, q, p, *[q, p] * n)) for n in (0, 2, 4)]
    assert len({wide_fingerprint(t.encode()) for t in texts}) == 1
    texts = [*texts, texts[1].upper()]  # the last is a copy, which equal fingerprints link
    found = similar_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert linked(range(3), [(r.a, r.b) for r in found]) == {0: 0, 1: 0, 2: 0}
    assert all(3 not in (r.a, r.b) for r in found)


def test_components_of_a_long_chain(spark):
    from perilmesh.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.member: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


# ------------------------------------------------------------- 8 license


def test_license_matches(spark, none):
    from perilmesh.llm.decontaminate import words_of
    from perilmesh.llm.license_scan import NOTICES, scan_licenses

    mit = NOTICES["MIT-grant"]
    bent = mit.replace("free of charge,", "free of any charge,").replace("sublicense, ", "")
    docs = [(1, "Intro words. " + mit + " tail"), (2, "x " * 50 + bent), (3, None), (4, ""), (5, "the software is free"), (6, "Released under the MIT License. " * 2), (7, mit[: len(mit) // 3])]
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word, round(r.coverage, 2)) for r in scan_licenses(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, license string")).collect())
    assert [g for g in got if g[0] == 1] == [(1, "MIT-grant", 2, 1 + len(words_of(mit.encode())), 1.0)]
    assert [(g[0], g[1], g[2]) for g in got if g[0] == 2] == [(2, "MIT-grant", 50)] and got[[g[0] for g in got].index(2)][4] > 0.95
    assert [g[:4] for g in got if g[0] == 6] == [(6, "MIT-notice", 0, 4), (6, "MIT-notice", 5, 9)]
    assert {g[0] for g in got} == {1, 2, 6} and scan_licenses(none).count() == 0


def test_whole_licenses_with_edits(spark, monkeypatch):
    """Recall of each whole text with a word in thirty changed, and of a block at a time."""
    import perilmesh.llm.license_scan as L

    rng = random.Random(11)
    whole = {k: v for k, v in L.library().items() if k not in L.NOTICES}
    docs = []
    for i, (name, text) in enumerate(sorted(whole.items())):
        words = text.split()
        bent = [rng.choice(["foo", w + "x"]) if rng.random() < 1 / 30 else w for w in words]
        docs.append((i, "some words before " + " ".join(bent) + " and after"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = L.scan_licenses(frame).collect()
    by = {(r.doc_id, r.license): r for r in found}
    for i, name in enumerate(sorted(whole)):
        assert (i, name) in by and by[i, name].coverage > 0.9 and abs(by[i, name].start_word - 3) <= 2, name
    other = sorted((r.doc_id, r.license) for r in found if r.license in whole and r.license != sorted(whole)[r.doc_id])
    assert {sorted(whole)[i] for i, _ in other} <= {"BSD-3-Clause", "BSD-2-Clause"}
    monkeypatch.setattr(L, "MOST_BYTES", 40_000)
    assert sorted(L.scan_licenses(frame).collect()) == sorted(found)


def test_alignment_is_a_longest_common_subsequence():
    from perilmesh.llm.license_scan import align

    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 10))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert align(a, b, 0, 0)[0] == best[-1, -1]


# ------------------------------------------------------------- 9 line dedup


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_against_plain(spark, odd, none, sf, batches):
    from perilmesh.llm.line_dedup import dedup_lines, line_key

    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        first = {}
        for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            for line in (t or "").split("\n"):
                first.setdefault(line_key(line, 10), i)
        want = Counter()
        for i, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if i is None or line_key(x, 10) is None or first[line_key(x, 10)] == i]
            want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
        got = dedup_lines(docs, batches=batches, fanout=2).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == want
        assert set(docs.columns) <= set(got[0].asDict())
    assert dedup_lines(none, batches=batches).count() == 0


# ------------------------------------------------------------- 10 toxicity


def test_kernel_of_spans_against_plain():
    from perilmesh.llm.toxicity import DECAY, SPAN, kernel, spans

    def plain(a, b):
        def weights(word):
            out, s = Counter(), f" {word} "
            for i in range(len(s) - 1):  # tuples start in the span and may end in the space behind it
                rest = range(i + 1, min(len(s), i + SPAN))
                for j in rest:
                    for k in (k for k in rest if k > j):
                        out[s[i] + s[j] + s[k]] += DECAY ** (k - i - 2)
                        for m in (m for m in rest if m > k):
                            out[s[i] + s[j] + s[k] + s[m]] += DECAY ** (m - i - 3)
            return out, len(s) ** 0.5

        (x, n), (y, m) = weights(a), weights(b)
        return sum(w * y[t] for t, w in x.items()) / n / m

    for a, b in (("idiot", "idixot"), ("the house", "the horse"), ("abc", "xyz"), ("a", "a")):
        both = [kernel(a, b), kernel(b, a)]
        assert both[0] == pytest.approx(both[1]) and both[0] == pytest.approx(plain(a, b), abs=0.1)
    assert kernel("idiot", "idixot") > 3 * kernel("idiot", "ribbon")
    s = spans(["One two three. Four\n\nfive! a.b", "", "..."])
    assert s.owner.tolist() == [0, 0, 0, 0, 0] or set(s.owner.tolist()) == {0}


def test_toxicity_learns_insults_from_sentences(spark):
    from perilmesh.llm.toxicity import ToxicityModel, _features, spans, train

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randrange(4, 9)))
    say = lambda n, more="": " ".join([*(word() for _ in range(n)), more, *(word() for _ in range(n))]) + "."
    insults = ["zorgak", "blixit", "quenfu", "hic sunt"]
    clean = [" ".join(say(5) for _ in range(3)) for _ in range(300)] + [f"{say(4)} {w} {say(3)}" for w in ("hic", "sunt") for _ in range(40)]
    toxic = [f"{say(4)} {say(3, rng.choice(insults))} {say(4)}" for _ in range(240)]
    model = train([spans([t]) for t in clean], [spans([t]) for t in toxic], rounds=3)
    score = lambda t: float(model.score(model.of_texts([t]))[0])
    fresh = [say(10) for _ in range(200)]
    assert sum(score(t) >= 0.3 for t in fresh) <= 6
    held = [say(4, rng.choice(insults)) for _ in range(100)]
    assert sum(score(t) >= 0.3 for t in held) >= 90
    near = [say(4, x) for x in ("zor.gak", "blixxit", "blixiit", "quenffu", "zorgaak") for _ in range(20)]
    assert sum(score(t) >= 0.3 for t in near) >= 60
    s = spans(["blixit zorgak"])  # the table is the machine: its value is linear in a span's features
    at, w = _features(s.codes, int(s.starts[0]), int(s.ends[0]))
    assert model.values(s)[0] == pytest.approx(model.bias + float((model.table[at] * w).sum()), rel=1e-4)
    long = " ".join([word() for _ in range(90_000)] + ["zorgak"] + [word() for _ in range(20_000)])
    assert model.of_texts([long, None, ""])[0] >= model.of_texts(["zorgak"])[0] - 1.5 and isinstance(model, ToxicityModel)
    assert model.of_texts(["!! ...", None]).tolist() == [model.bias] * 2


def test_toxicity_of_odd_rows(spark, odd, none):
    from perilmesh.llm.toxicity import fit_toxicity, score_toxicity, spans, train

    labels = spark.createDataFrame([(2, 1, 0), (3, 1, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (fit_toxicity(odd, labels), train([], []), train([], [spans(["x"])]), fit_toxicity(none, labels)):
        rows = score_toxicity(odd, model).collect()
        assert len(rows) == 8 and all(0 <= r.toxicity_score <= 1 and r.toxic_predicted == int(r.toxicity_score >= 0.3) for r in rows)
        assert len({r.toxicity_score for r in rows if r.doc_id == 3}) == 1
    assert score_toxicity(none, train([], [])).count() == 0


def test_toxicity_on_held_out_documents(spark):
    from perilmesh.llm.common import held_out
    from perilmesh.llm.toxicity import fit_toxicity, score_toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score_toxicity(docs.where(held_out()), fit_toxicity(docs, labels)).join(labels, "doc_id").select("toxic", "toxic_predicted").collect()
    c = Counter((r.toxic, r.toxic_predicted) for r in rows)
    assert c[1, 1] >= 0.8 * (c[1, 0] + c[1, 1]) and c[0, 1] <= 0.03 * (c[0, 0] + c[0, 1])


# ------------------------------------------------------------- columns of any name


def test_clashing_columns_come_back(spark):
    from perilmesh.llm.line_dedup import dedup_lines
    from perilmesh.llm.mixing import mix
    from perilmesh.llm.toxicity import score_toxicity, train

    names = ["_lost", "_source", "_seed", "_size", "_row", "a.b", "h", "fp", "rate", "n_lines", "Copies"]
    docs = spark.createDataFrame([(1, "a line of words\nx", "s", *range(11)), (2, "a line of words\ny", "s", *range(11))], "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    for out in (dedup_lines(docs), mix(docs), score_toxicity(docs, train([], []))):
        rows = out.collect()
        assert len(rows) == 2 and all(r["a.b"] == 5 and r["_lost"] == 0 and r["_source"] == 1 for r in rows)


# ------------------------------------------------------------- 11 quality rules


def test_quality_rules_learn_and_compile(spark, odd, none, sf):
    from pyspark.sql import functions as F

    from perilmesh.llm.quality_rules import STATISTICS, fit_quality, score_quality, with_statistics

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_quality(docs, labels, held_out=unseen)
    assert model.rules and fit_quality(docs, labels, held_out=unseen) == model
    rows = score_quality(docs, model).join(labels.where("quality IS NOT NULL"), "doc_id").where(unseen).select("quality", "quality_predicted").collect()
    bad = [r for r in rows if not r.quality]
    assert sum(r.quality_predicted for r in rows if r.quality) == len(rows) - len(bad) and sum(not r.quality_predicted for r in bad) >= 0.9 * len(bad)
    # the compiled expression beside a plain evaluation of the rules
    found = with_statistics(odd).join(score_quality(odd, model).select("size", "quality_score"), "size").collect()
    for r in found:
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all((low is None or r[n] > low) and (high is None or r[n] <= high) for n, low, high in rule.bounds))
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-total)))
    empty = [r for r in found if not r.text]
    assert empty and all(r[n] == 0 for r in empty for n in STATISTICS)
    assert score_quality(none, model).count() == 0


def test_quality_rules_odd_tables(spark, odd, none):
    from perilmesh.llm.quality_rules import fit_quality, score_quality

    schema = "doc_id long, quality int, toxic int"
    assert {r.quality_score for r in score_quality(odd, fit_quality(odd, spark.createDataFrame([], schema))).collect()} == {0.5}
    one = fit_quality(odd, spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, None, 1), (None, 0, 0)], schema))
    assert not one.rules and one.bias > 0
    both = fit_quality(odd, spark.createDataFrame([(3, 1, 0), (6, 0, 0), (7, 0, None)], schema))
    clash = odd.withColumnsRenamed({"n_chars": "quality_score", "lang": "_words", "source": "_log_words"})
    got = score_quality(clash, both)
    assert got.columns == ["doc_id", "text", "_words", "_log_words", "size", "quality_score", "quality_predicted"] and got.count() == len(ODD)


# ------------------------------------------------------------- 12 prefix trie


def _plain_trie(rows):
    from hashlib import sha256
    from zlib import crc32

    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((t is not None, t or 0), role, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = crc32(str(c).encode()) % 9
        own = [(x[1], x[3]) for x in sorted(convs[c])]
        base = [(x[1], x[3]) for x in sorted(convs.get(c - (c % 5 if c >= 0 else -(-c % 5)), []))]
        s = tuple(base[:h] + own[h:])
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
        ends[s].append(c)
    out = Counter()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        hashed = sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[(min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, hashed)] += 1
    return out


@pytest.mark.parametrize("held", [3, 20_000])
def test_prefix_trie_beside_plain(spark, monkeypatch, held):
    from perilmesh.llm import prefix_trie as p

    monkeypatch.setattr(p, "MOST_HELD", held)
    monkeypatch.setattr(p, "RANGE", 4)
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])) for c in [*range(-7, 24), None] for _ in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(30, 60) if c % 5 for t in range(12)] + [(100, t, "user", str(t)) for t in range(40)] * 2
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "CONV_ID")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = Counter(tuple(r) for r in p.prefix_trie(table.repartition(3)).select(*columns).collect())
    assert got == _plain_trie(rows)
    assert p.prefix_trie(table.limit(0)).count() == 0


# ------------------------------------------------------------- 13 ranked search


def _plain_search(docs, items, k):
    import math
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(words(t))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, c, n in texts:
            m = 75 + 25 * n * n_docs // n_terms
            scores.append((sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t]), d))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("how", [{"first": 2, "growth": 2, "k": 3}, {"first": 1, "growth": 4, "k": 5, "block_pairs": 6}, {}])
def test_ranked_search_beside_plain(spark, how):
    from perilmesh.llm.ranked_search import ranked_search

    rng = random.Random(13)
    pool = ["the", "of", "Été", "rare", "x1", "ΣΑΣ", "b", "c", "d", "e"]
    docs = [(i, " ".join(rng.choices(pool, weights=[9, 7, 2, 1, 1, 1, 3, 3, 2, 2], k=rng.choice([1, 2, 5, 40])))) for i in range(120)]
    docs += [(500 + i, "same text of d") for i in range(30)] + [(7, "the rare"), (7, "the rare"), (None, "RARE!x1"), (900, None), (901, ""), (902, "?!"), (903, "the " * 50_000 + "e")]
    items = [(1, "the rare of"), (2, "d d same"), (2, "e"), (3, None), (4, "absent"), (None, "Été x1"), (5, "ΣΑΣ c b the"), (6, "b" * 3)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, h int, terms int")
    got = Counter(tuple(r) for r in ranked_search(table.repartition(3), spark.createDataFrame(items, "item_id long, text string"), **how).collect())
    assert got == _plain_search(docs, items, how.get("k", 20))


def test_ranked_search_empty_tables(spark, none):
    from perilmesh.llm.ranked_search import ranked_search

    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked_search(none, items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search(docs, items).collect()] == [(1, 1, 1)]


def test_templates_of_one_license_and_clashing_columns(spark, odd):
    from perilmesh.llm.decontaminate import contamination
    from perilmesh.llm.license_scan import scan_licenses

    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"x {a} y", 0, "z"), (2, f"{b} end", 1, "z")], "doc_id long, text string, key long, ranges string")
    templates = spark.createDataFrame([("L", a), ("L", b)], "license string, template string")
    assert sorted((r.doc_id, r.license, r.coverage) for r in scan_licenses(docs, templates).collect()) == [(1, "L", 1.0), (2, "L", 1.0)]
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    for column in ("ranges", "h", "_doc"):
        got = contamination(odd.withColumnRenamed("size", column).unionByName(docs.select("doc_id", "text"), allowMissingColumns=True), items)
        assert [r.doc_id for r in got.where("contaminated").collect()] == [1]


def test_similar_links_rows_that_meet_by_coincidence(spark, monkeypatch):
    from perilmesh.llm import simhash as S

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=300))
    texts = [text() for _ in range(600)]  # unlike texts of one small vocabulary share many anchors
    texts += [texts[0] + " end", "start " + texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, plain = [], S.staged

    def counted(df, name, **options):
        out = plain(df, name, **options)
        if "key" in out.columns and "id" in out.columns:
            met.append(out.count())
        return out

    monkeypatch.setattr(S, "staged", counted)
    assert {tuple(r) for r in S.similar_links(docs).collect()} == {(0, 600), (1, 601)}
    assert met and max(met) <= 2 * 68 * 2, met  # two pairs with at most 68 anchors a text


def test_meeting_equals_all_pairs():
    import pyarrow as pa

    from perilmesh.llm import simhash as S

    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(-300, 300, 1500) // np.where(rng.random(1500) < 0.2, 100, 1))
    rows = np.stack([keys, np.arange(1500), *rng.integers(-(1 << 62), 1 << 62, (2, 1500)), rng.integers(1, 400, 1500)], axis=1)
    for i in rng.integers(1, 1500, 200):
        rows[i, 2:] = rows[i - 1, 2:]
    alike = set()
    for key, i, s0, s1, n in rows.tolist():
        for j in np.flatnonzero(keys == key).tolist():
            bits = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in ((s0, int(rows[j, 2])), (s1, int(rows[j, 3]))))
            if i != j and S._alike(np.array(n), rows[j, 4], np.array(bits)):
                alike.add((key, i))
    assert 100 < len(alike) < 1400
    for most in (4, 40, 5000):
        want = alike | {(k, i) for k, i in rows[:, :2].tolist() if (keys == k).sum() > most}
        for size in (1, 7, 64, 5000):
            batches = (pa.RecordBatch.from_arrays([pa.array(rows[i : i + size, k]) for k in range(5)], ["key", "id", "s0", "s1", "n"]) for i in range(0, 1500, size))
            got = [x for b in S._meeting(batches, most) for x in zip(b["key"].to_pylist(), b["id"].to_pylist())]
            assert len(got) == len(set(got)) and set(got) == want, (size, most)


def test_sketches_by_less_work(monkeypatch):
    from perilmesh.llm import version_sketch as V

    rng = random.Random(8)
    for most in (0, 5, 40, 700):
        a, b = ({rng.randrange(1 << 64) for _ in range(rng.randint(0, most))} for _ in range(2))
        b |= set(list(a)[: len(a) // 2])
        sketch = V.Sketch(8, a)
        counts, keys = [0] * 24, [0] * 24
        for k in a:
            for at in (k % 8, (k >> 21) % 8 + 8, (k >> 42) % 8 + 16):
                counts[at] += 1
                keys[at] ^= k
        assert sketch.counts.tolist() == counts and sketch.keys.tolist() == keys
        assert V.difference(a, b, sketch, V.Sketch(8, b)) == (a - b, b - a)
    words, hashed = [f"w{i}" for i in range(600)], []
    monkeypatch.setattr(V, "_hash", lambda x: hashed.append(x) or hash_of(x))
    import xxhash

    hash_of = xxhash.xxh3_64_intdigest
    pieces = V._of_piece(" ".join(words))
    assert len(hashed) < 600 + len(pieces)  # a word that ends a paragraph by its place isn't hashed


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_in_one_task_and_shuffled(spark, few):
    from perilmesh.llm.components import components

    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, 500 + i) for i in range(60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(3, 3), (None, 4)]
    root = {x: x for p in pairs for x in p if None not in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r["member"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}


def test_few_links_are_not_dealt_to_all_partitions(spark):
    from perilmesh.llm.components import components

    links, context, held = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").coalesce(1), spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        context.setJobGroup("few links", "")
        assert components(links).count() == 40
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("few links") for s in status.getJobInfo(j).stageIds}
        tasks = sum(info.numTasks for s in stages if (info := status.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert tasks < 10 * 61


def test_toxicity_trains_in_little_memory():
    import tracemalloc

    from perilmesh.llm.toxicity import spans, train

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 8)))
    good = [spans([" ".join(word() for _ in range(30))]) for _ in range(150)]
    bad = [spans([" ".join([word() for _ in range(30)] + ["vile zgoobqx"])]) for _ in range(150)]
    tracemalloc.start()
    try:
        model = train(good, bad, rounds=1, negatives=1500, hard_most=500)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 110
    assert model.of_texts(["a vile zgoobqx"])[0] > model.of_texts([" ".join(word() for _ in range(30))])[0]


def test_sketch_peels_no_table_twice_and_keeps_larger_ones(monkeypatch):
    from perilmesh.llm import version_sketch as V

    rng, puts = random.Random(11), []
    a, b, c = ({rng.randrange(1 << 64) for _ in range(n)} for n in (200, 220, 190))
    mix = V.Sketch._mix if hasattr(V.Sketch, "_mix") else V.Sketch._put
    name = mix.__name__
    monkeypatch.setattr(V.Sketch, name, lambda self, keys, *rest: (puts.append(len(keys)), mix(self, keys, *rest))[1])
    kept = getattr(V, "Digests", lambda x: x)
    sets = [kept(x) for x in (a, b, c)]
    small = [V.Sketch(8, x) for x in (a, b, c)]
    puts.clear()
    assert V.difference(sets[0], sets[1], small[0], small[1]) == (a - b, b - a)
    assert V.difference(sets[1], sets[2], small[1], small[2]) == (b - c, c - b)
    # each text is put into a larger sketch once, and each digest is taken out once
    assert sum(puts) == len(a) + len(b) + len(c) + len(a) + len(b) + len(b) + len(c)


def test_paragraphs_as_by_their_rule():
    import re

    from perilmesh.llm import version_sketch as V

    def plain(text):
        out, times = set(), Counter()
        for piece in re.split(r"[.!?]\s+|\n", text):
            words, own = V._words(piece), []
            for w in words:
                own.append(w)
                if len(own) == 3 or V._hash(w) % 3 == 0:
                    out_of = V._hash(" ".join(own))
                    times[out_of] += 1
                    own = []
            if own:
                times[V._hash(" ".join(own))] += 1
        for h, n in times.items():
            out |= {(h ^ k * V._ODD) & V._MASK for k in range(n)}
        return out

    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(["a", "bc", "d", "éß", "word" * 9, "x1"]) + rng.choice([" ", ". ", "\n", ".\n\n", "! ", "?", "\t", ".", "\x85", " .\r\n"]) for _ in range(n))
        assert V.digests(text) == plain(text)
    assert {n: V._CUT.split(n) for n in ("a.\n\nb", "\n.\n", ". .", "a?!  b\n")} == {n: re.split(r"[.!?]\s+|\n", n) for n in ("a.\n\nb", "\n.\n", ". .", "a?!  b\n")}
