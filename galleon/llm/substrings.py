"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier in the corpus.

Winnowing deals the work out: the smallest hash of the 16-byte grams inside a 100-byte string is the string's anchor,
so equal strings have equal anchors at equal places inside. An anchor and the strings that chose it, a run of
starts, are a stretch of text. Stretches with equal anchors meet; a stretch that equals an earlier one goes whole
(within an Arrow batch before anything is shuffled, so copies don't pile up). Of different stretches around one anchor
those can share a string that agree in the 42 bytes before or after the anchor; of these, the single strings whose
hashes come more than once are gathered into shards. Each shard gets a suffix array by induced sorting, and its permuted common
prefixes tell which starts have 100 bytes in common: all but the earliest go. Anchors with more than CROWD different
stretches are dealt out by the hashes of their single strings instead, so no task gets an unbounded group.

Null and empty texts, and texts of under 100 bytes, lose nothing. Order is by doc_id (nulls first), then by the
order of reading for rows that share a doc_id, then by start. Texts of any length are read whole, in overlapping parts.
The documents must come from a table: its rows are numbered in the order of reading, which is the same each time.
Stretches count as equal if the 64-bit hashes of their anchors and of their bytes both agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from galleon.llm.base import mapped, table, written
from galleon.llm.suffix import common_prefixes, suffix_array

LENGTH, GRAM = 100, 16
GRAMS = LENGTH - GRAM + 1
PART = 1 << 19
SHARD_BYTES = 1_000_000
CROWD = 20_000
INDEX = np.uint64((1 << 20) - 1)
BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[4]
    h = (h ^ (h >> np.uint64(29))) * ODD[5]
    return h ^ (h >> np.uint64(32))


def hashes(b: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of 4, 16, 32 and 64 bytes, each length from its half."""
    out, h, k = {}, BYTES[b], 1
    while k < 64:
        h = h[:-k] * ODD[k.bit_length()] + h[k:]
        k *= 2
        if k in (4, 16, 32, 64):
            out[k] = h
    return out


def strings(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hashes of the 100-byte strings at these places."""
    return mixed(h[64][at] * ODD[6] + h[32][at + 64] * ODD[7] + h[4][at + 96])


def stretches(b: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor's hash, the stretch's, those of the bytes beside the anchor) of runs of starts."""
    h = hashes(b)
    gram = mixed(h[16])
    m = (gram & ~INDEX) | np.arange(len(gram), dtype=np.uint64)
    k = 1
    while 2 * k <= GRAMS:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    m = np.minimum(m[: len(m) - (GRAMS - k)], m[GRAMS - k :])
    at = np.flatnonzero(valid[: len(m)])
    anchor = (m[at] & INDEX).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    lo = np.flatnonzero(new)
    hi = np.concatenate((lo[1:], [len(at)])) - 1
    first, last, place = at[lo], at[hi], anchor[lo]
    whole = mixed(strings(h, first) * ODD[1] + strings(h, last) * ODD[2] + (last - first).astype(np.uint64) * ODD[3] + (place - first).astype(np.uint64))
    # the bytes beside the anchor, where some string of the stretch has them; 0: none has
    before, after = np.where(place - first >= SIDE, place - SIDE, 0), np.where(last + LENGTH - GRAM - place >= SIDE, place + GRAM, 0)
    left = mixed(h[32][before] * ODD[1] + h[16][before + SIDE - 16]) >> np.uint64(49) | np.uint64(1)
    right = np.where(after > 0, mixed(h[32][np.minimum(after, len(h[32]) - 1)] * ODD[2] + h[16][np.minimum(after + SIDE - 16, len(h[16]) - 1)]) >> np.uint64(49) | np.uint64(1), 0)
    left = np.where(place - first >= SIDE, left, 0)
    return first, last, gram[place], whole, left.astype(np.int16), right.astype(np.int16)


def joined(found: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of about PART bytes: (bytes, text's number, where its piece starts here, where the piece starts in it)."""
    part, size, which, here, there = [], 0, [], [], []
    for i, t in enumerate(found):
        if len(t) < LENGTH:
            continue
        for lo in range(0, len(t) - LENGTH + 1, PART):
            piece = t[lo : lo + PART + LENGTH - 1]
            if part and size + len(piece) > PART + LENGTH:
                yield b"".join(part), np.array(which), np.array([*here, size]), np.array(there)
                part, size, which, here, there = [], 0, [], [], []
            part.append(piece)
            which.append(i)
            here.append(size)
            there.append(lo)
            size += len(piece)
    if part:
        yield b"".join(part), np.array(which), np.array([*here, size]), np.array(there)


#: A 100-byte string holds its anchor and, on one side of it, this many bytes more.
SIDE = (LENGTH - GRAM) // 2
#: Stretches of one anchor looked at together; an anchor with more passes all of them on, which only costs time.
TOGETHER = 500_000
SCHEMA = "g long, whole long, doc_id long, row long, start int, stop int, left short, right short, gone boolean"


def anchored(docs: DataFrame) -> DataFrame:
    """A row per stretch, its bytes from start to stop; gone: bytes of stretches that equal earlier ones of the same
    Arrow batch and needn't meet the others."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), np.array(batch.column("row").to_pylist(), np.int64)
            rank = np.zeros(len(ids), np.int64)  # the order of the batch's documents
            rank[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, rows[i]))] = np.arange(len(ids))
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for data, which, here, there in joined(batch.column("text").to_pylist()):
                b = np.frombuffer(data, np.uint8)
                valid = np.ones(len(b), bool)
                for end in here[1:]:
                    valid[max(0, end - LENGTH + 1) : end] = False
                first, last, gram, whole, left, right = stretches(b, valid)
                k = np.searchsorted(here, first, side="right") - 1
                for c, v in zip(cols, (gram.view(np.int64), whole.view(np.int64), which[k], first - here[k] + there[k], last - first, left, right), strict=True):
                    c.append(v)
            if not cols[0]:
                continue
            g, whole, which, start, span, left, right = (np.concatenate(c) for c in cols)
            order = np.lexsort((start, rank[which], whole, g))
            g, whole, which, start, stop = g[order], whole[order], which[order], start[order], (start + span)[order] + LENGTH
            gone = np.concatenate(([False], (g[1:] == g[:-1]) & (whole[1:] == whole[:-1])))
            # what is gone already is merged and dealt out by its row
            lost = np.flatnonzero(gone)[np.lexsort((start[gone], which[gone]))]
            w, lo, hi = which[lost], start[lost], stop[lost]
            new = np.concatenate(([True], (w[1:] != w[:-1]) | (lo[1:] > hi[:-1])))[: len(w)]
            end = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(w) - 1]))[: new.sum()]
            w, lo, hi = w[new], lo[new], hi[end]
            which = np.concatenate((which[~gone], w))
            yield {
                "g": np.concatenate((g[~gone], mixed(rows[w].astype(np.uint64)).view(np.int64))),
                "whole": np.concatenate((whole[~gone], np.zeros(len(w), np.int64))),
                "doc_id": batch.column("doc_id").take(pa.array(which)),
                "row": rows[which],
                "start": np.concatenate((start[~gone], lo)).astype(np.int32),
                "stop": np.concatenate((stop[~gone], hi)).astype(np.int32),
                "left": np.concatenate((left[order][~gone], np.zeros(len(w), np.int16))),
                "right": np.concatenate((right[order][~gone], np.zeros(len(w), np.int16))),
                "gone": np.arange(len(which)) >= len(which) - len(w),
            }

    return mapped(docs, step, SCHEMA)


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Rows sorted by g, in tables that end where an anchor ends: (table, True, False).

    An anchor of over `most` rows comes in several tables, not full ones; the later ones begin with the last row of the
    one before, to be compared with and then left out (carried).
    """
    held: list[pa.RecordBatch] = []
    size, split = 0, False
    for b in batches:
        if not b.num_rows:
            continue
        g = np.asarray(b.column("g"))
        cut = int(np.searchsorted(g, g[-1]))
        if held and g[0] != held[-1].column("g")[-1].as_py() or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]), not split, split
            held, size, split = [], 0, False
        held.append(b.slice(cut))
        size += b.num_rows - cut
        if size > most:
            yield pa.Table.from_batches(held), False, split
            # its last row stays: the next table's first row may equal it
            held, size, split = [held[-1].slice(held[-1].num_rows - 1)], 1, True
    if held:
        yield pa.Table.from_batches(held), not split, split


def met(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Stretches by anchor: gone ones, and the first of each different ones that may share a string with another."""
    names = ("g", "doc_id", "row", "start", "stop")

    def kept(batches: Iterator[pa.RecordBatch], aside: list) -> Iterator[pa.RecordBatch]:
        for b in batches:
            aside.append(b.filter(b.column("gone")))
            yield b.filter(pa.compute.invert(b.column("gone")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        aside: list[pa.RecordBatch] = []
        for t, full, carried in whole_groups(kept(batches, aside), together):
            while aside:
                lost = aside.pop()
                yield {k: lost.column(k) for k in (*names, "gone")}
            g, whole, left, right = (np.asarray(t.column(k)) for k in ("g", "whole", "left", "right"))
            again = np.concatenate(([False], (g[1:] == g[:-1]) & (whole[1:] == whole[:-1])))[: len(g)]
            first = np.flatnonzero(~again)[int(carried) :]
            if full:
                shared = np.zeros(len(first), bool)
                for side in (left, right):
                    key = mixed(g[first].view(np.uint64) + side[first].astype(np.uint64) * ODD[3])
                    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
                    shared |= (n[back] > 1) & (side[first] != 0)
                first = first[shared]
            at = pa.array(np.concatenate((np.flatnonzero(again), first)))
            yield {k: t.column(k).take(at).combine_chunks() for k in names} | {"gone": np.arange(len(at)) < again.sum()}
        while aside:
            lost = aside.pop()
            yield {k: lost.column(k) for k in (*names, "gone")}

    order = ("g", "whole", F.asc_nulls_first("doc_id"), "row", "start")
    dealt = rows.repartition("g").sortWithinPartitions(*order)
    return mapped(dealt, step, "g long, doc_id long, row long, start int, stop int, gone boolean")


def twice(data: list[bytes], spans: list[int]) -> list[np.ndarray]:
    """For each stretch of a shard: which of its starts have a string whose hash comes more than once in the shard."""
    text = np.frombuffer(b"".join(data), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(d) for d in data])))[:-1]
    n = np.array(spans) + 1
    at = np.repeat(first - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    _, back, count = np.unique(strings(hashes(text), at), return_inverse=True, return_counts=True)
    return np.split(count[back] > 1, np.cumsum(n)[:-1])


def repeated(text: bytes, first: list[int], spans: list[int]) -> np.ndarray:
    """Which starts of a shard have their 100 bytes in common with an earlier start.

    text: the stretches one after the other, in their order; first, spans: where each begins and its number of starts - 1.
    Gives the places in text of all starts but the earliest of each class of equal strings.
    """
    s = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    s = np.concatenate((s, [0]))
    sa = suffix_array(s)
    shared = common_prefixes(s.tolist(), sa, LENGTH)
    valid = np.zeros(len(s), bool)
    for a, n in zip(first, spans, strict=True):
        valid[a : a + n + 1] = True
    sa = np.array(sa)
    klass = np.cumsum(shared < LENGTH)[valid[sa]]
    place = sa[valid[sa]]
    order = np.lexsort((place, klass))
    klass, place = klass[order], place[order]
    return np.sort(place[np.concatenate(([False], klass[1:] == klass[:-1]))])


def runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[np.concatenate(([0], cut + 1))].tolist(), starts[np.concatenate((cut, [len(starts) - 1]))].tolist(), strict=True)


def sharded(rows: DataFrame) -> DataFrame:
    """(row, lo, hi): bytes to remove, from rows sorted by (key, name, order) within partitions.

    Rows without a name are stretches with their bytes, key being their anchor: they are gathered into shards. Rows
    with one are single strings of crowded anchors: of those with the same digest all but the first go.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size, last, known = 0, None, None

        def solve() -> dict:
            out: dict[str, list] = {"row": [], "lo": [], "hi": []}
            first, at = [], 0
            # only strings that can have an equal one here are sorted: an equal string has an equal hash
            parts = [(row, start + a, b - a, data[a : b + LENGTH]) for (row, start, _, data), hit in zip(held, twice([h[3] for h in held], [h[2] for h in held]), strict=True) for a, b in runs(np.flatnonzero(hit))]
            for _, _, _, data in parts:
                first.append(at)
                at += len(data)
            if not parts:
                return out
            found = repeated(b"".join(h[3] for h in parts), first, [h[2] for h in parts])
            which = np.searchsorted(first, found, side="right") - 1
            for k in np.unique(which).tolist():
                row, start, _, _ = parts[k]
                for a, b in runs(found[which == k] - first[k] + start):
                    for key, v in zip(out, (row, a, b + LENGTH), strict=True):
                        out[key].append(v)
            return out

        for b in batches:
            gone: dict[str, list] = {"row": [], "lo": [], "hi": []}
            for key, name, row, start, span, data in zip(*(b.column(k).to_pylist() for k in ("key", "name", "row", "start", "span", "data")), strict=True):
                if name is not None:
                    if name == known:
                        for k, v in zip(gone, (row, start, start + LENGTH), strict=True):
                            gone[k].append(v)
                    known = name
                    continue
                if key != last and size >= SHARD_BYTES:
                    yield solve()
                    held, size = [], 0
                held.append((row, start, span, data))
                size += len(data)
                last = key
            if gone["row"]:
                yield gone
        if held:
            yield solve()

    return mapped(rows, step, "row long, lo int, hi int")


def remove_repeats(docs: DataFrame, crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and removed (its spans)."""
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = written(met(anchored(text), together))
    spans = found.where("gone").select("row", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    differ = found.where("NOT gone").withColumn("span", F.col("stop") - F.col("start") - LENGTH)
    dealt = text.repartition("row")
    # anchors with more stretches than a task should get: at most rows / crowd of them
    big = differ.groupBy("g").count().where(F.col("count") > crowd).select("g", F.lit(True).alias("big"))
    wanted = differ.join(big, "g", "left").groupBy("row").agg(F.collect_list(F.struct("g", "start", "span", F.coalesce("big", F.lit(False)).alias("big"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "name", "doc_id", "row", "start", "span", "data")}
            for doc, row, t, wanted in zip(*(b.column(k).to_pylist() for k in ("doc_id", "row", "text", "wanted")), strict=True):
                for w in wanted:
                    if w["big"]:
                        for at in range(w["start"], w["start"] + w["span"] + 1):
                            name = hashlib.blake2b(t[at : at + LENGTH], digest_size=16).digest()
                            for key, v in zip(out, (int.from_bytes(name[:8], "little", signed=True), name, doc, row, at, 0, None), strict=True):
                                out[key].append(v)
                    else:
                        for key, v in zip(out, (w["g"], None, doc, row, w["start"], w["span"], t[w["start"] : w["start"] + w["span"] + LENGTH]), strict=True):
                            out[key].append(v)
            yield out

    pieces = mapped(dealt.join(wanted.hint("merge"), "row").select("doc_id", "row", "text", "wanted"), fetch, "key long, name binary, doc_id long, row long, start int, span int, data binary")
    order = ("key", F.asc_nulls_first("name"), F.asc_nulls_first("doc_id"), "row", "start")
    spans = spans.union(sharded(pieces.repartition("key").sortWithinPartitions(*order)))
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed")}
            for doc, t, spans in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
                merged: list[list[int]] = []
                for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(t[at:lo])
                    at = hi
                kept.append(t[at:])
                gone = sum(hi - lo for lo, hi in merged)
                for key, v in zip(out, (doc, len(t), gone, len(merged), b"".join(kept), ",".join(f"{a}:{z}" for a, z in merged)), strict=True):
                    out[key].append(v)
            yield out

    return mapped(dealt.join(lists.hint("merge"), "row", "left").select("doc_id", "text", "spans"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed string")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
