"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: pairs of adjacent bytes, and runs of one to three word shapes (case, what the
word ends on, length class, and whether it repeats the word before), and runs of four repeat flags. Each indicator is scaled by its class
log-count ratio, and a linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent. The
margin is mapped to (0, 1) by a logistic curve fitted on rows the model wasn't fitted on.

The model is fitted on at most SAMPLE labelled rows that aren't held out, in one task; every document is scored
whole. Null and empty texts have no n-grams and get the score of the bias alone. Without usable labels of both
classes every score is 0.5. Repeated rows, also those that share a doc_id or have none, get a row and equal scores
each. No rows: no rows. No row meets another, so no key can be hot.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from galleon.llm.base import fitted, held_out, labelled_sample, mapped, table, texts

#: At most so many labelled rows are learned from.
SAMPLE = 4000
#: A document is good from this score on.
CUT = 0.3
#: Byte pairs take the lower half of the feature space, word shapes the upper one.
HALF = 1 << 16
DIM = 2 * HALF
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 0 other, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 non-ASCII, 5.. punctuation by character.
KIND = np.zeros(256, np.int64)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b".,;:!?%$&*#|-'\"()[]{}<>=+_/\\@~^`"):
    KIND[_c] = 5 + _i
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def features(text: bytes, seen: np.ndarray) -> np.ndarray:
    """The ascending numbers of a text's n-grams. seen: DIM scratch flags, all false before and after."""
    b = np.frombuffer(text, np.uint8)
    if len(b) > 1:
        seen[(b[:-1].astype(np.int64) << 8) | b[1:]] = True
    if len(b):
        gap = np.concatenate(([True], SPACE[b], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        if len(start):
            n = end - start
            first, second, last = KIND[b[start]], KIND[b[np.minimum(start + 1, end - 1)]], KIND[b[end - 1]]
            total = np.add.reduceat(np.concatenate((b.astype(np.int64) * (b.astype(np.int64) + 7), [0])), start)[: len(start)]
            again = np.concatenate(([False], (n[1:] == n[:-1]) & (total[1:] == total[:-1])))
            shape = (((first * 40 + second) * 40 + last) * 4 + np.minimum(n // 4, 3)) * 2 + again
            shape = shape.astype(np.uint64)
            if len(again) > 3:  # runs of four "repeats the word before" flags, whatever the words look like
                flags = again.astype(np.int64)
                seen[DIM - 16 + flags[:-3] * 8 + flags[1:-2] * 4 + flags[2:-1] * 2 + flags[3:]] = True
            gram = shape * MIX[0]
            for k in range(3):
                if k:
                    if len(shape) <= k:
                        break
                    gram = gram[:-1] * MIX[1] + shape[k:] * MIX[2]
                code = gram ^ (gram >> np.uint64(29))
                seen[HALF + ((code * MIX[0] >> np.uint64(16)) % np.uint64(HALF - 16)).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights of the hinge-loss model over scaled indicators (the last one is the bias), by dual coordinate descent."""
    w, alpha, order = np.zeros(DIM + 1), np.zeros(len(rows)), np.random.default_rng(7)
    norm = np.array([np.sum(scale[r] ** 2) + 1.0 for r in rows])
    good, bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    box = np.where(y > 0, cost * len(y) / (2 * good), cost * len(y) / (2 * bad))
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            g = y[i] * (w[r] @ scale[r] + w[DIM]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), box[i])
            if (step := new - alpha[i]) != 0:
                w[r] += step * y[i] * scale[r]
                w[DIM] += step * y[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log-count ratio of each indicator, smoothed by one."""
    p, q = np.ones(DIM), np.ones(DIM)
    for r, v in zip(rows, y, strict=True):
        (p if v > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = margin.std() or 1.0
    x, a, c = margin / unit, 1.0, 0.0
    loss = lambda a, c: (np.logaddexp(0, a * x + c) - t * (a * x + c)).sum() + 1e-3 * a * a
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -35, 35)))
        s = p * (1 - p) + 1e-9
        ga, gc = ((p - t) * x).sum() + 2e-3 * a, (p - t).sum()
        haa, hac, hcc = (s * x**2).sum() + 2e-3, (s * x).sum(), s.sum()
        det = haa * hcc - hac**2
        if det <= 1e-14:
            break
        da, dc, step = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det, 1.0
        while step > 1e-6 and loss(a - step * da, c - step * dc) > loss(a, c):
            step /= 2
        a, c = a - step * da, c - step * dc
        if step * (abs(da) + abs(dc)) < 1e-8:
            break
    return (float(a / unit), float(c)) if np.isfinite(a) and np.isfinite(c) and a > 0 else (1.0, float(np.log((n1 + 1) / (n0 + 1))))


def fit(ids: list[int], found: list[bytes], label: list[int]) -> bytes:
    """The model as bytes: folded weights (scale times weight, bias last), slope and offset."""
    seen = np.zeros(DIM, bool)
    y = np.where(np.array(label, dtype=int) == 1, 1, -1)
    out = io.BytesIO()
    if len(set(y)) < 2:
        np.savez(out, w=np.zeros(DIM + 1, np.float32), curve=np.array([1.0, 0.0]))
        return out.getvalue()
    rows = [features(t, seen) for t in found]
    third = np.arange(len(rows)) % 3 == 0
    margin = np.zeros(len(rows))
    if len(set(y[~third])) == 2 and third.any():
        part = [r for r, t in zip(rows, third, strict=True) if not t]
        scale = ratios(part, y[~third])
        w = descend(part, y[~third], scale, 0.05, 10)
        margin = np.array([w[r] @ scale[r] + w[DIM] for r in rows])
        curve = platt(margin[third], y[third])
    else:
        curve = (1.0, 0.0)
    scale = ratios(rows, y)
    w = descend(rows, y, scale, 0.05, 10)
    np.savez(out, w=np.concatenate((w[:DIM] * scale, w[DIM:])).astype(np.float32), curve=np.array(curve))
    return out.getvalue()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> bytes:
    return fitted(labelled_sample(docs, labels, "quality", rows), fit)


def scores(model: bytes, found: list[bytes], seen: np.ndarray, loaded: dict) -> list[float]:
    if not loaded:
        z = np.load(io.BytesIO(model))
        loaded |= {"w": z["w"].astype(np.float64), "curve": z["curve"]}
    w, (a, c) = loaded["w"], loaded["curve"]
    margin = np.array([w[features(t, seen)].sum() + w[DIM] for t in found])
    return list(1 / (1 + np.exp(-np.clip(a * margin + c, -35, 35))))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: held_out, score and predicted (score >= cut)."""
    model = train(docs, labels)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, loaded = np.zeros(DIM, bool), {}
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            s = scores(model, b.column("text").to_pylist(), seen, loaded)
            yield {"doc_id": ids, "held_out": [held_out(i) for i in ids], "score": s, "predicted": [int(x >= cut) for x in s]}

    return mapped(texts(docs), step, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that the classifier accepts, with the columns they came with: scored in place, without a join."""
    model, schema = train(docs, labels), docs.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, loaded = np.zeros(DIM, bool), {}
        for b in batches:
            found = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([x >= cut for x in scores(model, found, seen, loaded)], pa.bool_()))

    return docs.mapInArrow(step, schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
