"""Benchmark decontamination by SimHash windows.

Texts and benchmark items are words (lower-case A-Z; runs of letters, digits and non-ASCII characters) and five-word
shingles, weighted by how few items have them. Windows of an item's own size slide over a document; each has a
128-bit weighted SimHash, and so has each item. An index over the items finds every fingerprint within RADIUS bits:
128 bits in BLOCKS blocks, so that RADIUS differing bits leave at least one block with one differing bit or none, and
each block's table holds its items under their value and its one-bit neighbours. Items found are then compared with
the window exactly, by weighted shingle similarity (sum of the smaller weights over the sum of the larger ones).
A window can reach the similarity only if its shingles that the item has weigh SIMILARITY of the item together, and
so only if it has one of the item's heaviest shingles, those without which the rest weighs less: windows that don't are
passed over before they are hashed, whatever the order of their words.

Items go to the tasks in parts of about PART_BYTES, one scan of the documents each. Weights are those of the whole
benchmark in every part: a shingle of one item weighs as much as one of none, so beside its items a part gets only the
shingles of two items or more. An item of fewer than five words is one shingle, met by equal windows of its size; null
and empty texts match nothing. Repeated items
and documents are each reported. Whole texts are scanned, and no document meets another, so no key can be hot.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from galleon.llm.base import mapped, table, texts
from galleon.llm.licenses import WORDS

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS, BLOCKS = 128, 41, 21
PART_BYTES = 8_000_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance int"
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1 for i in range(SHINGLE)], np.uint64)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_codes(ids: np.ndarray) -> np.ndarray:
    """A number for each run of SHINGLE word numbers; for all together if there are fewer."""
    n = max(len(ids) - SHINGLE + 1, min(len(ids), 1))
    v = ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    v ^= v >> np.uint64(31)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(ids))):
        out += v[i : i + n] * POWERS[i]
    return out ^ (out >> np.uint64(32))


def signs(codes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the BITS bits of each shingle's hash."""
    halves = []
    for salt in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = codes * np.uint64(salt)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        halves.append((h ^ (h >> np.uint64(32))).astype("<u8").view(np.uint8).reshape(-1, 8))
    return np.unpackbits(np.concatenate(halves, axis=1), axis=1, bitorder="little").astype(np.int8) * 2 - 1


class Index:
    """The items of one part: shingle weights, fingerprints and the tables of their blocks.

    total and spread, the number of items and the numbers of items of shingles that two or more have, are those of the
    whole benchmark; without them the part is the whole.
    """

    def __init__(self, items: list[tuple[int, bytes]], total: int | None = None, spread: dict[int, int] | None = None) -> None:
        split = [(i, w) for i, t in items if (w := words(t))]
        self.ids, self.sizes = [i for i, _ in split], [len(w) for _, w in split]
        self.vocabulary = {w for _, x in split for w in x}
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for k, (_, w) in enumerate(split):
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(k)
        codes = [shingle_codes(word_codes(w)) for _, w in split]
        self.bags = [Counter(c.tolist()) for c in codes]
        if spread is None:
            total, spread = len(split), Counter(k for bag in self.bags for k in bag)
        self.unseen = math.log(1 + total) if total else 1.0
        self.weight = {k: math.log(1 + total / n) for k, n in spread.items() if n > 1}
        self.known = np.array(sorted({k for bag in self.bags for k in bag}), np.uint64)
        # an item's heaviest shingles: what is left beside them weighs less than SIMILARITY of it
        self.heavy: dict[int, list[int]] = {}
        self.own, self.mass = [np.unique(c) for c in codes], []
        for k, bag in enumerate(self.bags):
            parts = sorted(((self.weight.get(c, self.unseen) * n, c) for c, n in bag.items()), key=lambda x: (-x[0], x[1]))
            mass = math.fsum(w for w, _ in parts)
            self.mass.append(mass)
            left = mass
            for w, code in parts:
                if left < SIMILARITY * mass * (1 - 1e-9):
                    break
                self.heavy.setdefault(code, []).append(k)
                left -= w
        self.edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
        self.prints = [self.packed((self.weights(c)[:, None] * signs(c)).sum(0)) for c in codes]
        self.tables: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for k, fp in enumerate(self.prints):
            for t, (v, size) in zip(self.tables, self.values(fp), strict=True):
                for near in (v, *(v ^ 1 << i for i in range(size))):
                    t.setdefault(near, []).append(k)

    def weights(self, codes: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(c, self.unseen) for c in codes.tolist()])

    @staticmethod
    def packed(total: np.ndarray) -> int:
        return int.from_bytes(np.packbits(total > 0, bitorder="little").tobytes(), "little")

    def values(self, fp: int) -> list[tuple[int, int]]:
        return [(fp >> a & (1 << b - a) - 1, b - a) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def near(self, fp: int) -> dict[int, int]:
        """Every item within RADIUS bits, with its distance."""
        found = {k for t, (v, _) in zip(self.tables, self.values(fp), strict=True) for k in t.get(v, ())}
        return {k: d for k in found if (d := (fp ^ self.prints[k]).bit_count()) <= RADIUS}

    def similarity(self, codes: np.ndarray, item: int) -> float:
        a, b = Counter(codes.tolist()), self.bags[item]
        weight = {k: self.weight.get(k, self.unseen) for k in a.keys() | b.keys()}
        low, high = (math.fsum(w * of(a[k], b[k]) for k, w in weight.items()) for of in (min, max))
        return round(low / high, 12) if high else 0.0  # 0.8 is 0.8 in whatever order weights are summed

    def search(self, text: bytes) -> list[tuple[int, int, int, float, int]]:
        """(item's number, start word, words, similarity, distance): the best window of each item at SIMILARITY or more."""
        if not self.ids:
            return []
        split = words(text)
        run = np.fromiter(map(self.vocabulary.__contains__, split), bool, len(split))
        best = self.equal(split, run)
        self.windows(split, run, best)
        return [(k, s, size, -neg, d) for k, (neg, s, size, d) in sorted(best.items())]

    def equal(self, split: list[bytes], run: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """The first window equal to each item of fewer than SHINGLE words."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, items in self.short.items():
            full = run[: max(0, len(run) - size + 1)].copy()
            for i in range(1, size):
                full &= run[i : len(run) - size + 1 + i]
            for s in np.flatnonzero(full).tolist():
                for k in items.get(tuple(split[s : s + size]), ()):
                    best.setdefault(k, (-1.0, s, size, 0))
        return best

    def windows(self, ids: list[bytes], run: np.ndarray, best: dict[int, tuple[float, int, int, int]]) -> None:
        """Adds the best window of each longer item."""
        if len(ids) < SHINGLE:
            return
        full = run[: len(ids) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            full &= run[i : len(ids) - SHINGLE + 1 + i]
        at = np.flatnonzero(full)
        if not len(at):
            return
        codes = shingle_codes(word_codes(ids))
        hit = codes[at]
        known = self.known[np.minimum(np.searchsorted(self.known, hit), len(self.known) - 1)] == hit
        at, hit = at[known], hit[known]
        starts: dict[int, list[np.ndarray]] = {}  # by window size
        for item in sorted({k for c in set(hit.tolist()) for k in self.heavy.get(c, ()) if self.sizes[k] >= SHINGLE}):
            size = min(self.sizes[item], len(ids))
            found = self.enough(item, at, hit, size - SHINGLE + 1, len(codes))
            if len(found):
                starts.setdefault(size, []).append(found)
        for size, places in starts.items():
            n, ordered = size - SHINGLE + 1, np.unique(np.concatenate(places))
            for group in np.split(ordered, np.flatnonzero(np.diff(ordered) > size) + 1):
                for lo in range(0, len(group), 4096):
                    some = group[lo : lo + 4096]
                    part = codes[some[0] : some[-1] + n]
                    total = np.concatenate((np.zeros((1, BITS)), np.cumsum(self.weights(part)[:, None] * signs(part), axis=0)))
                    sums = total[some - some[0] + n] - total[some - some[0]]
                    for s, row in zip(some.tolist(), sums, strict=True):
                        for item, d in self.near(self.packed(row)).items():
                            sim = self.similarity(codes[s : s + n], item)
                            if sim >= SIMILARITY and (-sim, s) < best.get(item, (2.0,))[:2]:
                                best[item] = (-sim, s, size, d)

    def enough(self, item: int, at: np.ndarray, hit: np.ndarray, n: int, most: int) -> np.ndarray:
        """Starts of windows of n shingles in which the item's shingles, hit at these places, weigh enough for it."""
        mine = self.own[item][np.minimum(np.searchsorted(self.own[item], hit), len(self.own[item]) - 1)] == hit
        at, mass = at[mine], np.concatenate(([0.0], np.cumsum(self.weights(hit[mine]))))
        out = []
        for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > n) + 1):
            s = np.arange(max(0, at[group[0]] - n + 1), min(at[group[-1]], most - n) + 1)
            inside = mass[np.searchsorted(at, s + n)] - mass[np.searchsorted(at, s)]
            out.append(s[inside >= SIMILARITY * self.mass[item] * (1 - 1e-9)])
        return np.concatenate(out)


#: The index that a worker made last, by its part's name: tasks of one query share it.
_index: dict[str, Index] = {}


def index_of(name: str, part) -> Index:
    if name not in _index:
        _index.clear()
        _index[name] = Index(*part.value)
    return _index[name]


def shipped(docs: DataFrame, benchmark: DataFrame, part_bytes: int) -> Iterator[Callable[[], Index]]:
    """For each part, what gives a task its index: a broadcast of the part's items, some part_bytes of text."""
    for part in parts(benchmark, part_bytes):
        yield partial(index_of, uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(part))


def parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[tuple[list[tuple[int, bytes]], int | None, dict[int, int] | None]]:
    """The items in parts of about part_bytes, with the arguments of their index; the driver holds one part at a time."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // part_bytes)
    total, spread = frequencies(items) if n > 1 else (None, None)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda r: (r[0] is None, r)), total, spread


def frequencies(items: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of items with words, and of each shingle of two items or more the number of items that have it."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [np.unique(shingle_codes(word_codes(w))) for t in b.column("text").to_pylist() if (w := words(t))]
            code = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            first = np.zeros(len(code), np.int64)
            first[np.cumsum([0, *map(len, found)])[:-1]] = 1
            yield {"code": code, "first": first}

    counted = mapped(items.select("text"), step, "code long, first long").groupBy("code").agg(F.count("*").alias("n"), F.sum("first").alias("first")).persist()
    total = counted.agg(F.sum("first")).first()[0] or 0
    spread = {r[0] % (1 << 64): r[1] for r in counted.where("n > 1").select("code", "n").collect()}
    counted.unpersist()
    return total, spread


def contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per document and item that the document holds: the best window, its similarity and Hamming distance."""
    found = []
    for made in shipped(docs, benchmark, part_bytes):

        def step(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[dict]:
            index = made()
            for b in batches:
                out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for k, s, size, sim, d in index.search(text):
                        for key, v in zip(out, (doc, index.ids[k], s, size, sim, d), strict=True):
                            out[key].append(v)
                yield out

        found.append(mapped(texts(docs), step, SCHEMA))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that hold no item, with the columns they came with: searched in place, without a join."""
    for made in shipped(docs, benchmark, part_bytes):

        def step(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            index = made()
            for b in batches:
                yield b.filter(pa.array([not index.search((t or "").encode()) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(step, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
