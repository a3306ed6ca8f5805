"""License scan: winnowed template fingerprints pick candidates, banded alignment judges them.

Templates are cut into shingles of ``SHINGLE`` words; of each window of neighbouring
shingles the one with the least hash is kept (winnowing) and goes into an inverted
index of (fingerprint, template, position).  All shingles of a document are looked
up, so a template that stands there with one kept shingle intact is a candidate.
Hits on nearby diagonals (document position less template position) form a
band, and template and document words are aligned inside the band.  A band of a long template is only
aligned if a tenth of its kept shingles are hit there: a coverage of 0.8 leaves two fifths of all shingles
intact at least, unless words are put in everywhere.

The library holds whole license texts (``licenses/*.txt``), and as templates of their own the one-line
notices, file headers and opening grants that stand for them.
"""

from __future__ import annotations


from collections import Counter
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, binary
from .decontaminate import words_of

SHINGLE, WINDOW, BAND = 3, 4, 12
#: So many bytes of templates are sent to every task at a time, one template at least.
MOST_BYTES = 4_000_000

#: Notices, file headers and opening grants of public licenses.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense-grant": "This is free and unencumbered software released into the public domain.",
}


def winnow(words: list[bytes]) -> list[tuple[int, int]]:
    """(hash, position) of the shingles that winnowing keeps; short texts keep at least one."""
    hashes = [xxhash.xxh3_64_intdigest(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []
    kept = {min(range(i, min(len(hashes), i + WINDOW)), key=lambda p: (hashes[p], -p)) for i in range(max(1, len(hashes) - WINDOW + 1))} if hashes else set()
    return [(hashes[p], p) for p in sorted(kept)]


def library() -> dict[str, str]:
    """All templates by name: the notices, and the whole texts."""
    texts = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return NOTICES | {f.stem: f.read_text(encoding="utf-8") for f in texts}


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(library().items()), "license string, template string")


def template_index(templates: DataFrame) -> DataFrame:
    """(fingerprint, license, position, shingle, template_key) of all winnowed shingles of (license, template); the key tells templates of one license apart."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for name, text, key in zip(b["license"].to_pylist(), binary(b["template"]), b["template_key"].to_pylist()):
                words = words_of(text)
                rows += [(h - (1 << 63), name, p, " ".join(w.decode() for w in words[p : p + SHINGLE]), key) for h, p in winnow(words)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["fingerprint", "license", "position", "shingle", "template_key"])

    keyed = templates.select("license", "template", F.xxhash64("license", "template").alias("template_key"))
    return keyed.mapInArrow(run, "fingerprint long, license string, position long, shingle string, template_key long")


def slack(length: int) -> int:
    """How far an alignment may leave a diagonal: short templates must not reach their next occurrence."""
    return max(1, min(BAND, length // 3))


def least_hits(length: int) -> int:
    """How many kept shingles of a template of so many words must be hit in a band."""
    return max(1, length // (5 * (WINDOW + 1)) if length > 100 else 1)


def bands(hits: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """(first, last) diagonal of each band from (document position, template position) hits.

    Hits go together while neighbouring diagonals differ by at most the template's slack
    and all of them by at most half its length.  Of a long template, diagonals count only if there are hits
    enough within the slack.
    """
    need, near = least_hits(length), slack(length)
    count = Counter(d - t for d, t in hits)
    if need > 1:
        strong = {x for x, n in count.items() if n * 4 >= need}  # a band has a main diagonal
        count = {x: n for x, n in count.items() if any(x + k in strong for k in range(-near, near + 1))}
    out: list[list[int]] = []
    for diagonal in sorted(count):
        if out and diagonal - out[-1][1] <= near and diagonal - out[-1][0] <= max(near, length // 2):
            out[-1][1] = diagonal
            out[-1][2] += count[diagonal]
        else:
            out.append([diagonal, diagonal, count[diagonal]])
    return [(a, b) for a, b, n in out if n >= need]


def align(template: list[bytes], words: list[bytes], first: int, last: int, margin: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence inside the band of diagonals first - margin to last + margin.

    Returns the number of matched words and the first and last matched position
    in ``words`` (of the alignment that starts latest, then ends earliest).
    """
    low, high = first - margin, last + margin
    # best (matches, start, -end) of alignments of template[:i] that end at or before a column
    before: dict[int, tuple[int, int, int]] = {}
    zero = (0, -1, 0)
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = zero
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            best = max(left, before.get(j, zero))
            if words[j] == word:
                n, start, _ = before.get(j - 1, zero)
                best = max(best, (n + 1, start if n else j, -j))
            row[j] = left = best
        before = row
    n, start, end = max(before.values(), default=zero)
    return n, start, -end


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, *, coverage: float = 0.8) -> DataFrame:
    """Matches of ``templates`` (license, template) in ``docs`` (doc_id, text).

    Returns a row per match whose matched share of the template's words is at least
    ``coverage``: doc_id, license, coverage, n_matched, start_word, end_word (positions among the
    document's words, both inclusive).  Words are runs of a-z, digits and non-ASCII, lower-cased.

    Templates that share a license are sought each, and each match is a row.  Null and empty texts, and templates without words, match nothing; repeated rows repeat
    their matches.  Fewer words than a shingle make one shorter shingle, which
    is sought as it is.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    known = templates.where("license IS NOT NULL AND template IS NOT NULL").select("license", "template").distinct()
    sizes = known.select(F.xxhash64("license", "template").alias("h"), F.octet_length("template").alias("n")).orderBy("h").collect()  # a row per template
    blocks, held = [[]], 0
    for r in sizes:
        if blocks[-1] and held + r["n"] > MOST_BYTES:
            blocks.append([])
            held = 0
        blocks[-1].append(r["h"])
        held += r["n"]
    found = [_scan(docs, known.where(F.xxhash64("license", "template").between(b[0], b[-1])) if b else known, coverage) for b in blocks]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _scan(docs: DataFrame, templates: DataFrame, coverage: float) -> DataFrame:
    """The matches of one block of templates."""
    spark = docs.sparkSession
    entries, texts = template_index(templates).collect(), templates.select("license", "template", F.xxhash64("license", "template").alias("key")).collect()
    names = {t["key"]: t["license"] for t in texts}
    index: dict[bytes, dict[tuple[bytes, ...], list[tuple[int, int]]]] = {}
    for e in entries:
        shingle = tuple(e["shingle"].encode().split(b" "))
        index.setdefault(shingle[0], {}).setdefault(shingle, []).append((e["template_key"], e["position"]))
    sent = spark.sparkContext.broadcast((index, {t["key"]: words_of((t["template"] or "").encode()) for t in texts}, names))

    def candidates(batches: Batches) -> Batches:
        by_word, library, _ = sent.value
        lengths = {k: sorted({len(s) for s in v}) for k, v in by_word.items()}
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"].to_pylist(), binary(b["text"])):
                words = words_of(text)
                hits: dict[int, list[tuple[int, int]]] = {}
                for p in [p for p, w in enumerate(words) if w in by_word]:
                    for n in lengths[words[p]]:
                        for key, at in by_word[words[p]].get(tuple(words[p : p + n]), ()):
                            hits.setdefault(key, []).append((p, at))
                for key, found in hits.items():
                    size = len(library[key])
                    for first, last in bands(found, size):
                        start = max(0, first - slack(size))
                        rows.append((i, key, start, first - start, last - start, b" ".join(words[start : last + size + slack(size)]).decode()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [*[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "key", "start", "first", "last", "segment"])

    def judged(batches: Batches) -> Batches:
        _, library, names = sent.value
        for b in batches:
            rows = []
            for i, key, start, first, last, segment in zip(*(b[c].to_pylist() for c in ("doc_id", "key", "start", "first", "last", "segment"))):
                template = library[key]
                n, low, high = align(template, segment.encode().split(b" "), first, last, slack(len(template)))
                if n and n >= coverage * len(template):
                    rows.append((i, names[key], n / len(template), n, start + low, start + high))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "license", "coverage", "n_matched", "start_word", "end_word"])

    found = docs.select("doc_id", "text").mapInArrow(candidates, "doc_id long, key long, start long, first long, last long, segment string")
    return found.mapInArrow(judged, "doc_id long, license string, coverage double, n_matched long, start_word long, end_word long")
