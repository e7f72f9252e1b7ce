"""First posts of score windows: like all pairs, whatever the scores, and without a row for every pair."""

import random

import pytest
from pyspark.sql import functions as F

from galleon.operators import sampling as sa

KIND = "post_id long, score double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def joined(df) -> int:
    """Most rows that a join of the frame gave; its query is run."""
    df.collect()

    def most(node) -> int:
        name, below = node.nodeName(), []
        if name == "AdaptiveSparkPlan":
            below = [node.executedPlan()]
        elif "QueryStage" in name:
            below = [node.plan()]
        else:
            kids = node.children()
            below = [kids.apply(i) for i in range(kids.size())]
        own = node.metrics().apply("numOutputRows").value() if "Join" in name and node.metrics().contains("numOutputRows") else 0
        return max([own, *map(most, below)])

    return most(df._jdf.queryExecution().executedPlan())


def key(i, seed):
    return i * seed % 2147483647, i


def scores(kind):
    r = random.Random(11)
    if kind == "few":
        return [(i, r.randrange(40) / 40) for i in range(300)]
    if kind == "edges":  # distances of the half width and of the gaps, give or take a rounding
        return [(i, i * 0.05) for i in range(30)] + [(100 + i, i * 0.01) for i in range(120)]
    if kind == "dense":  # one narrow heap, and few posts elsewhere
        return [(i, 0.5 + r.random() * 1e-4) for i in range(200)] + [(900 + i, r.random() * 3) for i in range(40)]
    if kind == "rising":  # order and score go together
        return [(i, i / 300) for i in range(300)]
    return [(i, r.uniform(-1, 1)) for i in range(250)] + [(700, 0.0), (701, -0.0), (702, 1e9), (703, float("inf")), (704, float("nan")), (705, None)]


@pytest.mark.parametrize("seed", [1, 99])
@pytest.mark.parametrize("kind", ["few", "edges", "dense", "rising", "odd"])
def test_first_posts_of_windows_like_all_pairs(spark, kind, seed):
    all_ = scores(kind)
    df = spark.createDataFrame(all_, KIND)
    fine = [(i, s) for i, s in all_ if s is not None and abs(s) < float("inf")]
    want = []
    for i, c in fine:
        near = sorted((j for j, s in fine if j != i and abs(s - c) <= 0.05), key=lambda j: key(j, seed))
        want += [(i, j, dict(fine)[j]) for j in near[:5]]
    got = sa.window_candidates(df, df.select(F.col("post_id").alias("seed_id"), F.col("score").alias("centre")), keep=5, seed=seed)
    assert rows(got) == sorted(want)


def test_windows_of_many_posts_make_no_pairs(spark):
    """8,000 posts with 1,600 in a window: a join gives some rows for each post, not 1,600."""
    df = spark.range(8000).select(F.col("id").alias("post_id"), ((F.col("id") * 53) % 1001 / 1000).alias("score"))
    assert joined(sa.window_candidates(df, df.select(F.col("post_id").alias("seed_id"), F.col("score").alias("centre")), half=0.1, keep=4, seed=99)) < 8000 * 20


@pytest.mark.parametrize("seed", [1, 99])
@pytest.mark.parametrize("kind", ["few", "edges", "dense", "rising", "odd"])
def test_partners_like_all_pairs(spark, kind, seed):
    all_ = scores(kind)
    df = spark.createDataFrame(all_, KIND)
    fine = [(i, s) for i, s in all_ if s is not None and abs(s) < float("inf")]
    want = []
    for i, c in fine:
        way = 1 if i % 2 else -1
        near = sorted((j for j, s in fine if j != i and 0.15 <= (s - c) * way <= 0.25), key=lambda j: key(j, seed))
        want += [(i, way, f"n{i}", c, j, dict(fine)[j]) for j in near[:3]]
    nodes = df.select("post_id", F.when(F.col("post_id") % 2 == 1, 1).otherwise(-1).alias("direction"), F.concat(F.lit("n"), "post_id").alias("note"))
    got = sa.calibration_partners(nodes, df, 3, seed)
    assert got.columns == ["post_id", "direction", "note", "own", "partner", "score"] and rows(got) == sorted(want)


def test_partners_of_many_posts_make_no_pairs(spark):
    df = spark.range(8000).select(F.col("id").alias("post_id"), ((F.col("id") * 53) % 1001 / 1000).alias("score"))
    assert joined(sa.calibration_partners(df.select("post_id", F.lit(1).alias("direction")), df, 4, 99)) < 8000 * 20
