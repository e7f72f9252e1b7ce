"""License scans: fuzzy search for short notices.

Texts are reduced to words (lower-case A-Z; runs of letters, digits and non-ASCII characters) joined by single
spaces. A notice of a known length with at most k errors, cut into k + 1 pieces, keeps at least one piece intact
(pigeonhole), so one Aho-Corasick pass over the pieces of all notices finds every place where a notice can be. The
regex library then matches the notice there with at most k errors and tells the span.

Null and empty texts have no words: counts of 0, empty labels, null places, score 0. Repeated rows, also
those that share a doc_id or have none, are each scanned. No rows: no rows. Other columns go, whatever their names.
Texts of any length are scanned whole; no row meets another, so no key can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from galleon.llm.base import LOWER, mapped, table, texts

#: Phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices searched with errors: text, label, number of errors allowed.
NOTICES = [
    ("under the mit license", "mit", 2),
    ("under the apache license version 2", "apache-2", 3),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("gnu general public license version 3", "gpl-3", 3),
    ("gnu general public license version 2", "gpl-2", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("free and unencumbered software released into the public domain", "unlicense", 5),
    ("all rights reserved", "all-rights-reserved", 1),
]

#: Places that touch are searched together up to so many characters; longer stretches overlap by a whole place.
STRETCH = 1000

#: Word characters as a table for bytes: everything else becomes a space.
WORDS = bytes(LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice cut into errors + 1 pieces of nearly equal length, with their starts."""
    n, k = len(notice), errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def searcher():
    """The automaton of all pieces and a bounded-error pattern for each notice; made once in each worker."""
    import ahocorasick
    import regex

    found: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, errors) in enumerate(NOTICES):
        for at, piece in pieces(notice, errors):
            found.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    patterns = [regex.compile(rf"(?b)\b(?:{regex.escape(n)}){{e<={k}}}\b") for n, _, k in NOTICES]
    return automaton, patterns


def fuzzy(words: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, errors) of every notice in the joined words, best match first at each place."""
    automaton, patterns = searcher()
    # the library puts no letter in at the place where a search begins or ends: there is a space around every window
    text = f" {words} "
    windows: dict[int, list[list[int]]] = {}
    for end, (length, where) in automaton.iter(text):
        for i, at in where:
            notice, _, k = NOTICES[i]
            start = max(0, end + 1 - length - at - k)
            stop = min(len(text), start + len(notice) + 2 * k + 1)
            spans = windows.setdefault(i, [])
            if spans and start <= spans[-1][1] and stop - spans[-1][0] <= STRETCH:
                spans[-1][:] = min(spans[-1][0], start), max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
    found = []
    for i, spans in windows.items():
        for start, stop in spans:
            # whole words at both ends, so that the pattern's word boundaries see what the text has there
            start = max(0, text.rfind(" ", 0, start + 1))
            stop = len(text) if (e := text.find(" ", stop)) < 0 else e + 1
            todo = [(start, stop)]
            while todo:  # the best match comes first: what lies before it is searched like what lies after it
                lo, hi = todo.pop()
                if m := patterns[i].search(text, lo, hi):
                    found.append((NOTICES[i][1], m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)))
                    todo += [(x, y) for x, y in ((lo, m.start()), (m.end(), hi)) if y - x >= len(NOTICES[i][0]) - NOTICES[i][2]]
    # the same place can look like two notices (version 2, version 3): the one with fewer errors stays
    found.sort(key=lambda x: (x[3], x[1], x[0]))
    kept: list[tuple[str, int, int, int]] = []
    for x in found:
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1:])


def scan(text: bytes) -> tuple:
    """One text's row without its id."""
    split = text.translate(WORDS).split()
    joined = b" " + b" ".join(split) + b" "
    places: list[tuple[int, str]] = []
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            places.append((joined.count(b" ", 0, at), label))
            at = joined.find(needle, at + 1)
    words = joined[1:-1].decode("utf-8", "replace")
    hits = fuzzy(words)
    own = {x[1] for x in places}
    labels = own | {x[0] for x in hits}
    score = 1.0 if own else max((1 - e / len(next(n for n, lab, _ in NOTICES if lab == label)) for label, _, _, e in hits), default=0.0)
    spans = ",".join(f"{label}:{words.count(' ', 0, a)}:{words.count(' ', 0, b) + 1}:{e}" for label, a, b, e in hits)
    starts = [x[0] for x in places]
    return len(split), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, spans


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: exact base phrases, all labels, a score and the notices' word spans (label:start:end:errors)."""
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = [scan(t) for t in b.column("text").to_pylist()]
            yield dict(zip(names, [b.column("doc_id"), *([list(x) for x in zip(*rows, strict=True)] or [[]] * 8)], strict=True))

    return mapped(texts(docs), step, SCHEMA)


def brute(text: str | None) -> tuple:
    """The base columns by the plain definition, for tests."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x[1] for x in places}))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
