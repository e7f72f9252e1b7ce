"""Blocks of near vectors move once for each group of blocks, not once for each block they meet."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sampling import joined

from galleon.operators import metric

KIND = "post_id long, embedding array<double>"


@pytest.mark.parametrize("groups,size", [(1, 1 << 20), (3, 1 << 20), (2, 4000)])
def test_blocks_move_once_for_each_group(spark, monkeypatch, groups, size):
    """Independent directions, where every block meets every other: 320 vectors in 40 blocks or more, half of them in a
    heap; groups of few and of many blocks give what all pairs give."""
    monkeypatch.setattr(metric, "GROUPS", groups, raising=False)
    monkeypatch.setattr(metric, "GROUP_BYTES", size, raising=False)
    g = np.random.default_rng(4)
    v = np.concatenate([g.normal(size=(160, 8)), g.normal(size=8) + g.normal(size=(160, 8)) * 0.3])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = g.permutation(320).tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], KIND)
    pairs = metric.near_pairs(df, 0.5, lambda x: x.checkpoint(), block=8)
    want = sorted(tuple(sorted((ids[i], ids[j]))) for i in range(320) for j in range(i) if u[i] @ u[j] >= 0.5)
    assert sorted(tuple(r) for r in pairs.collect()) == want and len(want) > 10_000
    blocks = metric.packed(metric.units_of(df), metric.pivots_of(metric.units_of(df), block=8), 1.0, 8).checkpoint()
    n, wide = blocks.count(), max(groups, math.ceil(320 * 64 / size))
    meets = metric.meeting(blocks, 1.0).checkpoint()
    assert n >= 40 and meets.count() > n * n / 3
    assert joined(metric.multiplied(blocks, meets, 0.5)) <= n * (wide + 1)


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [-2.0]), (5, [1.0, None])], KIND)
    got = {r["post_id"]: r["v"] for r in metric.units_of(df).select("post_id", F.col("v")).collect()}
    assert got == {1: [0.6, 0.8], 4: [-1.0]}


def test_tables_of_rounds_leave_no_shuffle_files(spark):
    from galleon.plans.views import as_table

    files = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    spark.range(10).repartition(3, "id").write.format("noop").mode("overwrite").save()
    was = files()
    table = as_table(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    assert was > 0 and files() <= was and sorted(r["count"] for r in table.collect()) == [142] * 1 + [143] * 6


def test_zero_vectors_are_in_no_group(spark):
    from galleon.operators.dedup import grouped_vectors

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [2.0, 0.0]), (6, None), (7, None)], KIND)
    assert sorted(tuple(r) for r in grouped_vectors(df, 0.01).select("member", "canonical").collect()) == [(4, 3), (5, 3)]


def test_pairs_may_come_twice_and_either_way(spark):
    from galleon.operators.dedup import assign_canonicals

    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (3, 4), (5, 5)], "a long, b long")
    for few in (0, 100):
        assert sorted(tuple(r) for r in assign_canonicals(pairs, few=few).collect()) == [(2, 1), (4, 3)]
