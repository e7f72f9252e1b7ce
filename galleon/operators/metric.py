"""Exact near pairs of vectors by a metric index: pivots, shells around them, and the triangle inequality.

Unit vectors lie on a sphere, where a cosine of 1 - t or more is a distance of at most r = sqrt(2 t). Every vector
belongs to the cell of its nearest pivot. Cells are sorted by distance from their pivot and packed into blocks; a block
knows how far its vectors are from each pivot that one of their neighbours can belong to. If x is in the cell of pivot
p and y within r of it, then d(y, p) <= d(y, nearest pivot of y) + 2 r, and d(x, p) and d(y, p) differ by r at most: only
blocks for which both can hold meet, found by an equi-join on cells and shells of width r. Blocks that meet move, and a
matrix product decides. Nothing near is missed, however the vectors lie; how much is ruled out depends on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from galleon.functions.columns import unit

#: Vectors of a block, and most pivots: they are what is broadcast (8 bytes a component).
BLOCK, PIVOTS = 1024, 1024
#: Groups of blocks at least, and bytes of one (a task keeps one group); most partitions, and rows of an Arrow batch.
GROUPS, GROUP_BYTES, TASKS, ROWS = 12, 64 << 20, 4096, 100_000
#: Distances are rounded: bounds are wider by this much. Shells are at least so wide.
SLACK, NARROW = 1e-6, 1e-3

Keep = Callable[[DataFrame], DataFrame]


def units_of(vectors: DataFrame) -> DataFrame:
    return vectors.select("post_id", unit(F.col("embedding")).alias("v")).where("v IS NOT NULL")


def pivots_of(units: DataFrame, most: int = PIVOTS, block: int = BLOCK) -> np.ndarray:
    """So many that a cell has about a block of vectors, `most` at most, chosen by a hash of their ids."""
    n = units.count()
    rows = units.orderBy(F.xxhash64("post_id"), "post_id").limit(min(most, max(1, n // block))).collect()
    return np.array([r["v"] for r in rows], float)


def packed(units: DataFrame, pivots: np.ndarray, radius: float, block: int = BLOCK, first: int = 0) -> DataFrame:
    """Blocks with ids above `first`: id, cell, lo and hi (distance from the cell's pivot), ids and m (packed floats), and `meets`: the cells
    where neighbours can be, each with the least and greatest distance from its pivot."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("v").to_pylist(), float)
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))
            home = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("post_id").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(x)), home])], names=["post_id", "v", "cell", "at"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        cell, ids, rows = -1, [], []

        def made() -> pa.RecordBatch:
            nonlocal number
            x = np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))
            near = np.flatnonzero((d - d[:, [cell]]).min(0) <= 2 * radius + SLACK)
            own = d[:, cell]
            meets = [{"cell": int(c), "lo": float(d[:, c].min()), "hi": float(d[:, c].max())} for c in near]
            number += 1
            row = {"id": pa.array([first + (part << 24) + number], pa.int64()), "cell": pa.array([cell], pa.int32()), "lo": [float(own.min())], "hi": [float(own.max())], "ids": [np.array(ids, "<i8").tobytes()], "m": [x.tobytes()], "n": pa.array([len(ids)], pa.int64())}
            return pa.RecordBatch.from_pydict(row | {"meets": pa.array([meets], pa.list_(pa.struct([("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())])))})

        for b in batches:
            for i, v, c in zip(b.column("post_id").to_pylist(), b.column("v").to_pylist(), b.column("cell").to_pylist(), strict=True):
                if rows and (c != cell or len(rows) == block):
                    yield made()
                    ids, rows = [], []
                cell = c
                ids.append(i)
                rows.append(v)
        if rows:
            yield made()

    at = units.mapInArrow(placed, "post_id long, v binary, cell int, at double")
    sorted_ = at.repartitionByRange("cell", "at", "post_id").sortWithinPartitions("cell", "at", "post_id")
    return sorted_.mapInArrow(blocks, "id long, cell int, lo double, hi double, ids binary, m binary, n long, meets array<struct<cell int, lo double, hi double>>")


def meeting(blocks: DataFrame, radius: float, new: DataFrame | None = None) -> DataFrame:
    """(x, y): ids of blocks that the triangle inequality can't keep apart, each two once; x among `new` ones if given."""
    width, reach = max(radius, NARROW), radius + SLACK
    shells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.lit(width)).cast("int"), F.floor(hi / F.lit(width)).cast("int"))).alias("shell")
    home = blocks.select(F.col("id").alias("y"), "cell", F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), shells(F.col("lo"), F.col("hi")))
    guests = (blocks if new is None else new).select(F.col("id").alias("x"), F.explode("meets").alias("c")).select("x", "c.cell", "c.lo", "c.hi").select("*", shells(F.greatest(F.col("lo") - reach, F.lit(0.0)), F.col("hi") + reach))
    found = guests.join(home, ["cell", "shell"]).where((F.col("lo") <= F.col("hi_y") + reach) & (F.col("lo_y") <= F.col("hi") + reach))
    return found.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def moved_blocks(blocks: DataFrame, meets: DataFrame) -> tuple[DataFrame, int]:
    """(task, others, id, ids, m) and the number of tasks: each task is for two groups of blocks, and gets each of their
    blocks that meets another once; `others` are those of the first group that one of the second meets, null for the first.

    So what moves is each block once for each group, and not once for each block that it meets.
    """
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("m")), F.lit(0))).first()
    groups = max(1, min(2 * n, max(GROUPS, math.ceil(size / GROUP_BYTES))))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    first, second = (F.when(group("x") >= group("y"), F.col(p)).otherwise(F.col(q)) for p, q in (("x", "y"), ("y", "x")))
    pairs = meets.select(first.alias("held"), second.alias("id")).withColumn("hi", group("held"))
    pairs = pairs.select((F.col("hi") * (F.col("hi") + 1) / 2 + group("id")).cast("int").alias("task"), "held", "id")
    held = pairs.select("task", F.lit(None).cast("array<long>").alias("others"), F.col("held").alias("id")).distinct()
    passed = pairs.groupBy("task", "id").agg(F.collect_list("held").alias("others")).select("task", "others", "id")
    return held.union(passed).join(blocks.select("id", "ids", "m"), "id").select("task", "others", "id", "ids", "m"), groups * (groups + 1) // 2


def multiplied(blocks: DataFrame, meets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: near vectors of blocks that meet. A task keeps one group of blocks, which another passes by."""
    moved, tasks = moved_blocks(blocks, meets)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, found, many = None, {}, [], 0

        def made() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("task", "others", "id", "ids", "m")}
                if r["task"] != task:
                    task, held = r["task"], {}
                j = np.frombuffer(r["ids"], "<i8")
                y = np.frombuffer(r["m"], float).reshape(len(j), -1)
                if r["others"] is None:
                    held[r["id"]] = j, y
                    continue
                for x_id in r["others"]:
                    i, x = held[x_id]
                    p, q = np.nonzero(x @ y.T >= 1 - threshold)
                    a, c = i[p], j[q]
                    fits = (a < c) if x_id == r["id"] else (a != c)
                    if fits.any():
                        found.append((np.minimum(a, c)[fits], np.maximum(a, c)[fits]))
                        many += len(found[-1][0])
                    if many >= ROWS:
                        yield made()
                        found, many = [], 0
        if found:
            yield made()

    dealt = moved.repartitionById(min(tasks, TASKS), F.col("task") % min(tasks, TASKS))
    return dealt.sortWithinPartitions("task", F.col("others").isNotNull(), "id").mapInArrow(multiply, "a long, b long")


def near_pairs(vectors: DataFrame, threshold: float, keep: Keep, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b), a < b: all pairs with a cosine of 1 - threshold or more, exactly. keep() materialises the blocks."""
    units = units_of(vectors)
    centres, radius = pivots_of(units, pivots, block), math.sqrt(2 * max(threshold, 0.0))
    if not len(centres):
        return units.select(F.col("post_id").cast("long").alias("a"), F.col("post_id").cast("long").alias("b")).limit(0)
    blocks = keep(packed(units, centres, radius, block))
    return multiplied(blocks, meeting(blocks, radius), threshold)


def moved_share(vectors: DataFrame, threshold: float, keep: Keep, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[int, int]:
    """(pairs of blocks that meet, all pairs of blocks)."""
    units, radius = units_of(vectors), math.sqrt(2 * max(threshold, 0.0))
    blocks = keep(packed(units, pivots_of(units, pivots, block), radius, block))
    n = blocks.count()
    return meeting(blocks, radius).count(), n * (n + 1) // 2


def near_classes(vectors: DataFrame, threshold: float, keep: Keep, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): equal vectors are one class, named by its smallest id, with its number of posts; pairs are of
    classes, with the number of pairs of posts each stands for. Pairs inside a class are counted in `classes`."""
    least = keep(vectors.groupBy("embedding").agg(F.min("post_id").alias("rep"), F.count("*").alias("copies")))
    classes = least.select("rep", "copies", (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("inner_pairs"))
    pairs = near_pairs(least.select(F.col("rep").alias("post_id"), "embedding"), threshold, keep, block)
    sized = lambda end: least.select(F.col("rep").alias(end), F.col("copies").alias(f"n_{end}"))
    stands = pairs.join(sized("a"), "a").join(sized("b"), "b")
    return stands.select("a", "b", (F.col("n_a") * F.col("n_b")).alias("post_pairs")), classes
