"""SimHash near-dedup by segment popcounts.

A fingerprint is cut into segments of two bits; the bit counts of the segments embed it in a small grid. Flipping a
bit moves one count by one, so the Manhattan distance of two embeddings is never more than the Hamming distance of
the fingerprints. Fingerprints within three bits therefore have embeddings within three, and one half of the segments
within one. The range join on that grid: each half's counts, packed into a number, are a cell; a fingerprint stands in
its own cell and asks in the cells one step up. Every pair within one step meets (the one with fewer bits asks), and
the exact Hamming distance decides. Equal fingerprints are one node beforehand, and of the links inside a cell only a
spanning forest leaves it: never all pairs.

The general operator for near copies takes these components, of every row, and joins to them what is alike further
than three bits apart, where a grid of popcounts rules out too little: texts whose five-word shingle sets have an exact
similarity of 0.8 or more. For these cells are bands of the sets' smallest hashes, so the chance to meet depends on the
similarity alone, not on where a copy was edited. A sketch of 1,024 bits refutes most pairs of a cell, a spanning forest
of the rest is verified by the exact similarity of the sets, and where an edge fails, the other pairs around it are
compared too, in blocks, unless verified edges connect them. Neither way stands for the other: a link of either is kept.

Null and empty texts have no shingles and the fingerprint zero. Rows that share a doc_id share a component when their
fingerprints do; null ids come back as they are and never become a component's name unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from galleon.llm.base import LOWER, mapped, table, texts, written
from galleon.llm.licenses import WORDS
from galleon.operators.graph import connected_components

RADIUS = 3
XX = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Shingles with repeats, space-joined; fewer words than that: the whole sequence; no words: none."""
    w = text.translate(LOWER).split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' hashes."""
    s = shingles(text, words)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(s), 1 << 16):
        h = np.fromiter(map(XX, s[lo : lo + (1 << 16)]), np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(s), bitorder="little").tobytes(), "little") if s else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield {"doc_id": b.column("doc_id"), "fp": pa.array(fps)}

    return mapped(texts(docs), step, "doc_id long, fp long")


def cells(fps: DataFrame) -> DataFrame:
    """Rows (cell, asks, fp): each fingerprint in its own cell of either half, and asking in those one step up."""
    def counts(half):  # pairs of bits become their counts, 00, 01 or 10
        return half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))

    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(counts(low), counts(high).bitwiseOR(F.lit(1 << 32)))).alias("cell"))
    # a count of two can't grow: its field is 10, and only fields 00 and 01 get a step
    steps = F.array(*[F.when(F.col("cell").bitwiseAND(F.lit(2 << (2 * i))) == 0, F.col("cell") + F.lit(1 << (2 * i))) for i in range(16)])
    asked = F.filter(F.concat(F.array(F.col("cell")), steps), lambda c: c.isNotNull())
    return halves.select("fp", F.posexplode(asked).alias("at", "cell")).select("cell", (F.col("at") > 0).alias("asks"), "fp")


class Forest:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def linked(own: np.ndarray, asks: np.ndarray, radius: int, block: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest of a cell's links: pairs of owners, and of an asker and an owner, within the radius."""
    every = np.concatenate((own, asks))
    forest, out = Forest(len(every)), []
    for lo in range(0, len(every), block):
        for at in range(0, min(len(own), lo + block), block):
            near = np.bitwise_count((every[lo : lo + block, None] ^ own[None, at : at + block]).view(np.uint64)) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                if j + at < i + lo and forest.join(int(i) + lo, int(j) + at):
                    out.append((int(every[i + lo]), int(own[j + at])))
    return out


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell numbers, rows) of whole cells from batches sorted by cell: pieces of arrow columns as numpy arrays."""
    left: list[np.ndarray] | None = None
    for b in batches:
        cols = [np.asarray(b.column(i)) if not pa.types.is_boolean(b.column(i).type) else b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        cols = cols if left is None else [np.concatenate(x) for x in zip(left, cols, strict=True)]
        last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0
        left = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if left is not None and len(left[0]):
        yield left


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within the radius, by way of others too."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for cell, asks, fp in grouped(batches):
            edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            first, last = edge[:-1], edge[1:]
            owners = np.add.reduceat(~asks, first)
            a, b = [], []
            for lo, hi in zip(*(x[(last - first > 1) & (owners > 0)].tolist() for x in (first, last)), strict=True):
                f, q = fp[lo:hi], asks[lo:hi]
                for x, y in linked(f[~q], f[q], radius):
                    a.append(x)
                    b.append(y)
            if a:
                yield {"a": a, "b": b}

    dealt = cells(fps).repartition("cell").sortWithinPartitions("cell")
    return mapped(dealt, step, "a long, b long").distinct()


def near_copies(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    keep = partial(written)
    found = keep(fingerprints(docs, words))
    nodes = keep(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(keep(links(nodes.select("fp"), radius)), keep)
    # fingerprints without links are components of their own
    named = nodes.join(parts, nodes["fp"] == parts["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return found.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


# --- near copies by exact similarity, for whole corpora -----------------------------------------------------------

#: Similarity of five-word shingle sets from which on two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Cells: so many bands of so many smallest hashes. A pair at a similarity of 0.8 shares no cell with a probability of
#: (1 - 0.8 ** 4) ** 15, or 0.04 %, whatever was edited.
BANDS, DEEP = 15, 4
#: Bins of the bit sketch: one bit of the smallest shingle code of each.
BINS = 1024
#: Members of a cell that one task gets at most; larger cells are cut into blocks. Members of all blocks of a cell.
CELL, HUBS = 512, 8
#: Members of a group of unsettled nodes that one task gets at most, twice.
BLOCK = 2048


_rng = np.random.default_rng(17)
SALTS, ODDS = _rng.integers(0, 1 << 32, BANDS * DEEP, np.uint32), _rng.integers(0, 1 << 32, BANDS * DEEP, np.uint32) | np.uint32(1)
POWERS = _rng.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)


def shingle_codes(words: list[bytes]) -> np.ndarray:
    """Different 64-bit codes of the five-word shingles, ascending."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    v = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        codes += (v[i : i + n] ^ v[i : i + n] >> np.uint64(29)) * POWERS[i]
    return np.unique((codes ^ codes >> np.uint64(32)) * POWERS[0])


def sketched(words: list[bytes]) -> tuple[list[int], bytes, int]:
    """The cells, the bit sketch and the size of the set of shingles; nothing if there are fewer words than a shingle has."""
    codes = shingle_codes(words)
    if not len(codes):
        return [], b"", 0
    best, small = np.full(BANDS * DEEP, np.iinfo(np.uint32).max), (codes >> np.uint64(16)).astype(np.uint32)
    for lo in range(0, len(codes), 1024):
        np.minimum(best, ((small[lo : lo + 1024, None] ^ SALTS) * ODDS).min(0, initial=np.iinfo(np.uint32).max), out=best)
    raw = best.tobytes()
    cells = [xxhash.xxh3_64_intdigest(raw[4 * DEEP * k : 4 * DEEP * (k + 1)], seed=k) - (1 << 63) for k in range(BANDS)]
    bins = (codes >> np.uint64(54)).astype(np.int64)  # codes ascend, so a bin's smallest comes first
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    bits = np.zeros(BINS, np.uint8)
    bits[bins[first]] = codes[first] >> np.uint64(9) & np.uint64(1)
    return cells, np.packbits(bits).tobytes(), len(codes)


def limit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits that sketches of sets of these sizes have at most at a similarity of SIMILARITY.

    Of the bins that the union fills, a share of 1 - SIMILARITY has another smallest code, and half of these another
    bit. More than 4.5 standard deviations beyond that are met by about one pair in 300,000.
    """
    filled = BINS * (1 - np.exp(-(a + b) / ((1 + SIMILARITY) * BINS)))
    share = (1 - SIMILARITY) / 2
    return share * filled + 4.5 * np.sqrt(share * (1 - share) * filled) + 2


def sketch(docs: DataFrame) -> DataFrame:
    """row, doc_id, a digest of the word sequence, the cells, the bit sketch and the number of shingles.

    Texts of fewer words than a shingle has get no cells: they are like equal sequences only, which are one node.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            split = [t.translate(WORDS).split() for t in b.column("text").to_pylist()]
            found = [sketched(w) for w in split]
            yield {"row": b.column("row"), "doc_id": b.column("doc_id"), "same": [xxhash.xxh3_128_digest(b" ".join(w)) for w in split], "cells": [c for c, _, _ in found], "bits": [x for _, x, _ in found], "size": [n for _, _, n in found]}

    return mapped(docs, step, "row long, doc_id long, same binary, cells array<long>, bits binary, size int")


def members(nodes: DataFrame) -> DataFrame:
    """(cell, row, blocks): the nodes of every cell that has several, and into how many blocks the cell is cut."""
    placed = nodes.select("row", F.explode("cells").alias("cell"))
    # counted before they meet, so a hot cell is one row here
    several = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    return placed.hint("merge").join(several, "cell").select("cell", "row", "blocks")


def unpacked(bits: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, BINS // 64)


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by the key, and where the groups begin and end."""
    left: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(key))
        last = int(np.searchsorted(keys, keys[-1]))
        if last or left and left[-1].column(key)[-1].as_py() != keys[0]:
            yield edges_of(pa.Table.from_batches([*left, b.slice(0, last)]), key)
            left = []
        left.append(b.slice(last))
    if left:
        yield edges_of(pa.Table.from_batches(left), key)


def edges_of(t: pa.Table, key: str) -> tuple[pa.Table, np.ndarray]:
    t = t.combine_chunks()
    k = np.asarray(t.column(key))
    return t, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))


def nearest(row: np.ndarray, bits: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of the pairs within their limit, by distance as a share of it."""
    n = len(row)
    best, by, todo, at, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), 0, []
    todo[0] = False
    for _ in range(n - 1):
        d = np.bitwise_count(bits ^ bits[at]).sum(1) / limit(size, size[at])
        closer = todo & (d < best)
        best[closer], by[closer] = d[closer], at
        at = int(np.where(todo, best, np.inf).argmin())
        if not todo[at]:
            at = int(np.flatnonzero(todo)[0])
        todo[at] = False
        if best[at] <= 1:
            out.append((int(row[at]), int(row[by[at]])))
    return out


def candidates(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, b, cell), a < b: a spanning forest of the pairs within their limit, of each block of each cell.

    Some members of a cell of several blocks, the same for all, stand in every block and tie the blocks together.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t, at in grouped_rows(batches, "deal"):
            row, cell, size, bits = np.asarray(t.column("row")), np.asarray(t.column("cell")), np.asarray(t.column("size")), unpacked(t.column("bits"))
            first, n = at[:-1], np.diff(at)
            two = first[n == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1) <= limit(size[two], size[two + 1])]
            a, b, c = row[two].tolist(), row[two + 1].tolist(), cell[two].tolist()
            for lo, m in zip(first[n > 2].tolist(), n[n > 2].tolist(), strict=True):
                for x, y in nearest(row[lo : lo + m], bits[lo : lo + m], size[lo : lo + m]):
                    a.append(x)
                    b.append(y)
                    c.append(int(cell[lo]))
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield {"a": np.minimum(a, b), "b": np.maximum(a, b), "cell": c}

    blocked = held.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("row"), "row"))  # limited before it is dealt
    hubs = blocked.where("blocks > 1").withColumn("place", place).where(F.col("place") <= HUBS)
    others = hubs.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("b <> block").select("cell", "row", F.col("b").alias("block"))
    every = blocked.select("cell", "row", "block").union(others).select("cell", "row", F.xxhash64("cell", "block").alias("deal"))
    with_bits = every.hint("merge").join(nodes.select("row", "bits", "size"), "row")
    return mapped(with_bits.repartition("deal").sortWithinPartitions("deal", "row"), step, "a long, b long, cell long")


def settled(groups: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect, by way of each other, all pairs of a group that are within their limit and have this
    similarity, but for those whose components are one already.

    groups: grp, row, blocks, bits, size, component. Any two blocks of a group meet once, with the codes of their
    shingles, and what leaves them is a forest, however many pairs there are.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"row": b.column("row"), "codes": [shingle_codes(t.translate(WORDS).split()).tobytes() for t in b.column("text").to_pylist()]}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t, at in grouped_rows(batches, "deal"):
            row, part, side, size, bits = *(np.asarray(t.column(k)) for k in ("row", "component", "side", "size")), unpacked(t.column("bits"))
            codes = t.column("codes")
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if (part[lo:hi] == part[lo]).all():
                    continue
                mine = [np.frombuffer(codes[i].as_py(), np.uint64) for i in range(lo, hi)]
                names, node = np.unique(part[lo:hi], return_inverse=True)  # the group's components, by number
                forest, one = Forest(len(names)), side[lo:hi] < 2  # side 0: all against all; 1 against 2
                y = np.arange(hi - lo) if (side[lo:hi] == 0).all() else np.flatnonzero(~one)
                far, many = bits[lo:hi], size[lo:hi]
                out: tuple[list, list] = ([], [])
                for i in np.flatnonzero(one).tolist() if len(y) else ():
                    later = y[y > i] if one.all() else y
                    later = later[node[later] != node[i]]
                    if not len(later):
                        continue
                    d = np.bitwise_count(far[later] ^ far[i]).sum(1) / limit(many[later], many[i])
                    order = np.argsort(d, kind="stable")
                    for j in later[order[d[order] <= 1]].tolist():
                        if forest.top(int(node[i])) != forest.top(int(node[j])):
                            a, b = mine[i], mine[j]
                            both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                            if both >= similarity * (len(a) + len(b) - both):
                                forest.join(int(node[i]), int(node[j]))
                                out[0].append(int(row[lo + i]))
                                out[1].append(int(row[lo + j]))
                if out[0]:
                    a, b = map(np.array, out)
                    yield {"a": np.minimum(a, b), "b": np.maximum(a, b)}

    codes = written(mapped(own.hint("merge").join(groups.select("row").distinct(), "row", "left_semi"), coded, "row long, codes binary"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
    pairs = groups.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("int")
    dealt = pairs.select(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("deal"), "row", side.alias("side"), "component", "size", "bits")
    whole = dealt.hint("merge").join(codes, "row").repartition("deal").sortWithinPartitions("deal", "row")
    return mapped(whole, step, "a long, b long").distinct()


def word_shingles(text: bytes) -> set[bytes]:
    w = text.translate(WORDS).split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))) if len(w) > SHINGLE else {b" ".join(w)}


def verified(edges: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The edges whose ends' shingle sets have this similarity or more, from whole texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keep, last, mine = [], None, set()
            for a, x, y in zip(b.column("a").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if a != last:
                    last, mine = a, word_shingles(x)
                other = word_shingles(y)
                both = len(mine & other)
                keep.append(both >= similarity * (len(mine) + len(other) - both))
            yield {"a": b.column("a").filter(pa.array(keep)), "b": b.column("b").filter(pa.array(keep))}

    # merge joins by name: what meets the texts grows with the corpus, and the plan is the same at every size
    with_b = edges.hint("merge").join(own.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    both = with_b.hint("merge").join(own.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
    return mapped(both.select("a", "b", "x", "y"), step, "a long, b long")


def linked_copies(nodes: DataFrame, text: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of all nodes with a near copy: every pair of a cell within its limit is connected by verified
    edges, or has been compared and refuted.

    Each block's spanning forest is verified first: if its edges hold, all its pairs within the limit are connected.
    Where an edge fails, or a cell has several blocks, what hangs together by edges, good or bad, and by such cells is
    a group; the nodes of its components are compared once more, group by group.
    """
    held = written(members(nodes))
    own = written(text.join(held.select("row").distinct().hint("merge"), "row", "left_semi").select("row", "text"))
    found = written(candidates(held, nodes))
    good = written(verified(found.select("a", "b").distinct(), own, similarity))
    parts = written(connected_components(good, written))
    large = held.where("blocks > 1")
    hung = large.join(large.groupBy("cell").agg(F.min("row").alias("b")).hint("merge"), "cell").select(F.col("row").alias("a"), "b")
    named = connected_components(found.select("a", "b").union(hung), written).select(F.col("id").alias("row"), F.col("component").alias("grp"))
    both = named.hint("merge").join(parts.select(F.col("id").alias("row"), "component"), "row", "left").select("grp", "row", F.coalesce("component", "row").alias("component"))
    both = written(both)
    mixed = both.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = mixed.select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    groups = written(both.hint("merge").join(mixed, "grp").hint("merge").join(nodes.select("row", "bits", "size"), "row"))
    more = written(settled(groups, own, similarity))
    if more.isEmpty():
        return parts
    more = verified(more, own, similarity)
    known = parts.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return connected_components(more.select("a", "b").union(known), written)


def copy_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id and first: the row number of the first document (by doc_id, then reading order) of its group.

    Groups hold equal word sequences, and what is linked by a similarity of `similarity` or more. row numbers the
    rows in reading order; the frame must give its rows in the same order each time it is read, as a table does.
    """
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    found = written(sketch(text))
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")
    nodes = written(found.groupBy("same").agg(F.min(place).alias("place"), F.min("cells").alias("cells"), F.min("bits").alias("bits"), F.min("size").alias("size")).select("same", "place", F.col("place.row").alias("row"), "cells", "bits", "size"))
    parts = linked_copies(nodes, text, similarity)
    named = nodes.join(parts, nodes["row"] == parts["id"], "left").select("same", "place", F.coalesce("component", "row").alias("component"))
    firsts = named.groupBy("component").agg(F.min("place").alias("least"))
    by_node = named.join(firsts, "component").select("same", F.col("least.row").alias("first"))
    return found.join(by_node, "same").select("row", "doc_id", "first")


def later_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row: the rows that aren't the first (by doc_id, then reading order) of what they are linked to, by near_copies or
    by copy_groups, by way of both.
    """
    # rows are the ids here: documents may share one or have none
    near = written(near_copies(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id"))
    alike = written(copy_groups(docs, similarity))
    # a component and a group are each named by a row of their own, so they meet in the rows that both hold
    ties = alike.join(near.hint("merge"), "row").select(F.col("first").alias("a"), F.col("component_id").alias("b"))
    parts = connected_components(ties, written)
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")
    firsts = alike.where("row = first").select("row", place.alias("place"))
    met = written(firsts.join(parts, firsts["row"] == parts["id"]).select("row", "component", "place"))
    least = met.groupBy("component").agg(F.min("place").alias("least"))
    beaten = met.join(least.hint("merge"), "component").where("row <> least.row").select("row")
    return alike.where("row <> first").select("row").union(beaten)


def drop_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that are copies or near copies of an earlier one: one of each group stays.

    The columns come back as they were, whatever their names; docs is read again by each step, in the same order, as a
    table is.
    """
    number = unused(docs)
    gone = written(later_copies(docs, similarity).select(F.col("row").alias(number)))
    return docs.withColumn(number, F.monotonically_increasing_id()).join(gone.hint("merge"), number, "left_anti").drop(number)


def unused(docs: DataFrame) -> str:
    """A column name that the frame hasn't got."""
    name = "row_number"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name
