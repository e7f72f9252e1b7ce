"""Graph operators on edge tables: connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Edges that a task shortens together.
TOGETHER = 200_000


def shortened(pairs: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, with the same components: what is connected within TOGETHER edges of a task becomes a star."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        n = 0

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        def star() -> pa.RecordBatch:
            ends = [(x, r) for x in list(up) if (r := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n > TOGETHER:
                yield star()
                up.clear()
                n = 0
        yield star()

    return pairs.mapInArrow(step, "a long, b long")


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) for every end of the edges (columns a, b): component is the smallest id that can be reached.

    Large-star and small-star steps in turn, until nothing changes: the number of rounds grows with the logarithm of a
    component's size, and each step is one aggregation and one join on the node, so that no component is ever gathered
    in one place. Before each round tasks shorten the paths among the edges they hold; once no more than TOGETHER edges
    are left, one task does so with all of them and is done. keep() materialises a round's edges (a checkpoint by
    default) so that the plan stays short. Null ends and self loops are dropped. Empty input: empty output.
    """
    keep = keep or (lambda df: df.checkpoint())
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    last = None
    while True:
        pairs = keep(shortened(pairs).distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] <= TOGETHER:
            pairs = keep(shortened(pairs.coalesce(1)))
            break
        if (now["n"], now["h"]) == last:
            break
        last = (now["n"], now["h"])
        # large star: each node's larger neighbours are linked to the smallest node around it
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours are linked to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    members = pairs.groupBy("a").agg(F.min("b").alias("component"))
    return members.select(F.col("a").alias("id"), "component").union(members.select(F.col("component").alias("id"), "component").distinct())
