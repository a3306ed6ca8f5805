"""Each stage of the pipeline on its own input, beside a plain version."""

from collections import Counter


def test_stages(spark, sf):
    import corpus_pipeline as P
    from perilmesh.llm.decontaminate import words_of
    from perilmesh.llm.line_dedup import line_key
    from perilmesh.llm.simhash import fingerprint, shingle_hashes

    docs, seen = P.documents(spark, sf), {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = P.staged(stage(spark, docs, sf), name)
        seen[name] = before, docs.collect()
        assert docs.columns[:5] == P.COLUMNS
    before, after = seen["toxicity"]
    model = P.fit_toxicity(P.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {i: float(model.score(model.of_texts([r.text]))[0]) for i, r in before.items()}  # each text by itself
    assert {r.doc_id for r in after} == {i for i, x in scores.items() if x < 0.3} and len(after) > 0.7 * len(before)

    before, after = seen["line_dedup"]
    first = {}
    for i in sorted(before):
        for line in (before[i].text or "").split("\n"):
            first.setdefault(line_key(line, 10), i)
    want = {i: "\n".join(x for x in r.text.split("\n") if line_key(x, 10) is None or first[line_key(x, 10)] == i) for i, r in before.items()}
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t.strip(" \t\n\x0b\x0c\r") or t == before[i].text}

    before, after = seen["simhash_near_dedup"]
    kept = {r.doc_id for r in after}
    prints = {i: fingerprint(r.text.encode()) for i, r in before.items()}
    sets = {i: set(shingle_hashes(r.text.encode(), 5).tolist()) for i, r in before.items()}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in set(before) - kept:  # whoever goes has somebody like it that stays or goes with it
        assert any(alike(i, j) for j in before if j != i)
    assert not [(i, j) for i in kept for j in kept if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    close = [(i, j) for i in before for j in before if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(not (i in kept and j in kept) for i, j in close) >= 0.9 * len(close)

    before, after = seen["decontamination"]
    windows = {}
    for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        own = words_of(b.text.encode())
        for s in range(max(1, len(own) - 12)):
            windows.setdefault(len(own[s : s + 13]), set()).add(tuple(own[s : s + 13]))
    clean = set()
    for i, r in before.items():
        words = words_of(r.text.encode())
        hit = {q for n, ws in windows.items() for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in ws for q in range(p, p + n)}
        if not (hit and 20 * len(hit) >= len(words)):
            clean.add(i)
    assert {r.doc_id for r in after} == clean

    before, after = seen["mixing"]
    copies = Counter(r.doc_id for r in after)
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    size = lambda t: len(t.encode().split())
    taken, whole = sum(size(r.text) for r in after), sum(size(r.text) for r in before.values())
    assert 1.3 * whole < taken < 1.7 * whole


def test_queries_are_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {x if x == "pipeline" else x.split("_")[0] for x in names}
    assert set(E.oracle_sql()) <= names


def test_stages_of_an_empty_table(spark, sf):
    import corpus_pipeline as P

    docs = P.documents(spark, sf).limit(0)
    for name, stage in P.STAGES:
        docs = P.staged(stage(spark, docs, sf), name)
        assert docs.columns[:5] == P.COLUMNS and docs.count() == 0
