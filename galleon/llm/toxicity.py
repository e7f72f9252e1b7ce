"""Toxicity: a noisy-channel decoder restores disguised words, then a linear model scores the restored text.

A word may reach the text through a channel that writes digits and signs for letters (leetspeak), puts separators
between letters (spacing) and repeats letters. Places that such a channel can have made become lattices of
characters; Viterbi search finds the most likely letters under a character trigram model whose counts come from all
documents. Text elsewhere has one reading only and stays. Words of the restored text, with weights from class
log-count ratios, give the score through a logistic curve.

The word weights are learned in one task from at most SAMPLE labelled rows that aren't held out. Null and empty texts
have no words and get the score of the curve's offset. Without labels of both classes every score is 0.5. Repeated
rows get equal scores; texts of any length are read whole; the trigram table has a fixed size.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleon.llm.base import LOWER, fitted, held_out, labelled_sample, mapped, table, texts
from galleon.llm.quality import platt

#: At most so many labelled rows are learned from.
SAMPLE = 6000
#: A word counts if chance would have it in toxic rows as often with this probability at most, over all words tried.
CHANCE = 0.01
#: Letters a-z are 1 to 26, all other letters 27, anything between words 0.
SIGNS = 28
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}

CODE = np.zeros(256, np.int64)
CODE[97:123], CODE[128:] = np.arange(1, 27), 27
LETTER = CODE > 0
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in LEET]] = True
APART = np.zeros(256, bool)
APART[[ord(c) for c in " ._-*"]] = True
WORD = bytes(LOWER[c] if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Runs of one letter or sign over LONG count as LONG: what they can stand for stays the same.
LONG = 8
RUNS = re.compile(rb"([a-z0134578@$!|+])\1{%d,}" % LONG)
#: Signs amid letters, after them or before them; single letters with one separator after each; a letter three times
#: or more. Places have any length; each kind starts at a run's beginning only, so time is in proportion.
PLACES = re.compile(
    rb"(?<![a-z0134578@$!|+])[a-z0134578@$!|+]*[a-z][0134578@$!|+]+[a-z][a-z0134578@$!|+]*"
    rb"|(?<![a-z])[a-z]{2,}[0134578@][0134578@$!|+]*"
    rb"|(?<![a-z0-9@$!|+])[0134578@$!|+]+[a-z]{2}[a-z0134578@$!|+]*"
    rb"|(?<![a-z0-9\x80-\xff])[a-z0134578@$!|+](?:[ ._*-][a-z0134578@$!|+]){3,}(?![a-z0-9\x80-\xff])"
    rb"|(?<![a-z])[a-z]*([a-z])\1\1[a-z]*"
)
#: Log-probability that a single separator between single letters stands between two words, as in spaced-out sentences.
BREAK = -3.0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all whole texts: SIGNS cubed numbers, summed in the tasks first."""
    size = SIGNS**3

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for text in joined(b.column("text").to_pylist()):
                c = CODE[np.frombuffer(b"  " + text.translate(LOWER) + b" ", np.uint8)]
                total += np.bincount((c[:-2] * SIGNS + c[1:-1]) * SIGNS + c[2:], minlength=size)
        at = np.flatnonzero(total)
        yield {"gram": at, "n": total[at]}

    counts = np.zeros(size)
    for gram, n in mapped(texts(docs), step, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    return counts


def joined(found: list[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The texts, short ones put together with gaps between them: fewer and larger arrays."""
    part, n = [], 0
    for t in found:
        part.append(t)
        n += len(t) + 2
        if n >= size:
            yield b"  ".join(part)
            part, n = [], 0
    if part:
        yield b"  ".join(part)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a character after two others, interpolated with shorter contexts."""
    c = counts.reshape(SIGNS, SIGNS, SIGNS) + 0.0
    one = (c.sum((0, 1)) + 1) / (c.sum() + SIGNS)
    two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
    return np.log((c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5))


def lattice(place: str) -> list[list[tuple[str, float]]]:
    """For each run of the place: what it can stand for, with the channel's log-probability."""
    spaced = len(place) > 6 and all(c in " ._*-" for c in place[1::2])
    out, dotted = [], "." in place
    for m in re.finditer(r"(.)\1*", place, re.S):
        end = m.end() == len(place)
        c, n = m[1], len(m[0])
        if c in " ._*-":
            out.append([("", 0.0), (" ", -1.0 if c == " " and dotted else BREAK)] if spaced else [(" ", 0.0)])
        elif c in LEET:
            out.append([(x * k, -0.7 - (0.3 if k < n else 0)) for x in LEET[c] for k in {1, n, min(n, 2)}] + ([("", -0.7)] if end and c in "!|+$" else []))
        elif n >= 3:
            out.append([(c, -0.5), (c * 2, -0.9), (c * n, -4.0)])
        else:
            out.append([(c * n, 0.0)] + ([(c, -1.5)] if n == 2 else []))
    return out


def restore(place: bytes, lm: np.ndarray) -> bytes:
    """The likeliest reading of a place: Viterbi search with the last two characters as state and links back."""
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for arcs in [*lattice(place.decode("latin-1")), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, back) in beam.items():
            for out, cost in arcs:
                x, y, q = a, b, p + cost
                for ch in out:
                    z = int(CODE[ord(ch) & 255])
                    q += lm[x, y, z]
                    x, y = y, z
                if (x, y) not in new or q > new[x, y][0]:
                    new[x, y] = (q, (back, out))
        beam = new
    back, parts = max(beam.values(), key=lambda v: v[0])[1], []
    while back:
        back, out = back
        parts.append(out)
    return "".join(reversed(parts)).strip().encode("latin-1")


def suspicious(b: np.ndarray) -> bool:
    """Whether any place of the lower-cased text can come from the channel; a cheap test without misses."""
    if len(b) < 3:
        return False
    letter, sign = LETTER[b], SIGN[b]
    if (sign[1:] & letter[:-1])[:-1].any() and (sign[1:-1] & (letter[2:] | sign[2:])).any():
        return True
    if (sign & (b != 33) & (b != 36) & (b != 43) & (b != 124))[1:][letter[:-1]].any():  # a digit or @ after a letter
        return True
    if (sign[:-1] & letter[1:]).any() or (letter[2:] & (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2])).any():
        return True
    if len(b) < 7:
        return False
    mark, apart = letter | sign, APART[b]
    return bool((mark[:-6] & apart[1:-5] & mark[2:-4] & apart[3:-3] & mark[4:-2] & apart[5:-1] & mark[6:]).any())


def restored(text: bytes, lm: np.ndarray) -> list[bytes]:
    """The words of the restored text."""
    lower = text.translate(LOWER)
    if suspicious(np.frombuffer(lower, np.uint8)):
        lower = PLACES.sub(lambda m: restore(m[0], lm), RUNS.sub(lambda m: m[1] * LONG, lower))
    return lower.translate(WORD).split()


def words(text: bytes, lm: np.ndarray) -> set[bytes]:
    return set(restored(text, lm))


def fit_with(lm: np.ndarray):
    def fit(ids: list[int], found: list[bytes], label: list[int]) -> bytes:
        """Word weights and the curve, as JSON."""
        y = np.array(label, dtype=int)
        if len(set(label)) < 2:
            return json.dumps({"w": {}, "curve": [1.0, 0.0]}).encode()
        sequences = [restored(t, lm) for t in found]
        bags = [set(x) for x in sequences]

        def weights(rows: list[int]) -> dict[bytes, float]:
            count = (Counter(), Counter())
            for i in rows:
                count[y[i]].update(bags[i])
            n1, n0 = max(1, sum(y[i] for i in rows)), max(1, sum(1 - y[i] for i in rows))
            out, share = {}, n1 / (n1 + n0)
            # copies of a toxic text don't make its words toxic: places after the same word count once
            after: dict[bytes, set[bytes]] = {}
            for i in rows:
                if y[i]:
                    for before, w in zip([b"", *sequences[i]], sequences[i], strict=False):
                        after.setdefault(w, set()).add(before)
            tried = sum(t >= 3 for t in count[1].values())
            for w, t in count[1].items():
                t = min(t, len(after[w]))
                n = t + count[0][w]
                if t >= 3 and (p := t / n) > share:  # Chernoff's bound on the chance of so many
                    excess = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)
                    if n * excess > math.log(tried / CHANCE):
                        out[w] = math.log((t + 0.5) / (n1 + 1)) - math.log((count[0][w] + 0.5) / (n0 + 1))
            return out

        half = [i for i in range(len(y)) if i % 2]
        part, rest = weights(half), np.array([i for i in range(len(y)) if i % 2 == 0])
        f = np.array([sum(part[w] for w in bags[i] & part.keys()) for i in rest])
        curve = platt(f, np.where(y[rest] == 1, 1, -1)) if len(set(y[rest])) == 2 else (1.0, -3.0)
        return json.dumps({"w": {w.decode("latin-1"): v for w, v in weights(list(range(len(y)))).items()}, "curve": list(map(float, curve))}).encode()

    return fit


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """One row per document: held_out, score and predicted (score >= cut)."""
    lm = language_model(trigram_counts(docs)).astype(np.float32)
    model = fitted(labelled_sample(docs, labels, "toxic", SAMPLE), fit_with(lm))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        z = json.loads(model)
        w, (a, c) = {k.encode("latin-1"): v for k, v in z["w"].items()}, z["curve"]
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            f = [sum(w[x] for x in words(t, lm) & w.keys()) for t in b.column("text").to_pylist()]
            s = [1 / (1 + math.exp(-max(-35.0, min(35.0, a * x + c)))) for x in f]
            yield {"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": s, "predicted": [int(x >= cut) for x in s]}

    return mapped(texts(docs), step, SCHEMA)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
