"""Samplers for annotation: seeded draws, strata, similar pairs, score windows, close pairs, calibration, groups.

Draws order by an arithmetic key of id and seed, so that they can be repeated. A batch has some tens of seeds; what is
near a seed, or inside its score window, is found by one join over all posts and cut to tens of candidates each before
anything is grouped, and the greedy choice inside a group is a small Python helper over these. A post that two seeds
want goes to the earlier one, so a batch spends no post twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from galleon.functions.columns import cosine, shuffle_key
from galleon.operators.annotations import main_component, unbounded, win_loss

#: Sizes and limits of the samplers.
DEGREE_CAP, CLUSTER, PER_CLUSTER, MIN_DISTANCE, SAME = 3, 48, 24, 0.04, 0.94
WINDOW, WINDOW_DRAW, WINDOW_KEEP, BLOCK, REVISITS, ANCHORS = 0.05, 96, 32, 6, 2, 200
CALIBRATION_SHARE, GAP_LOW, GAP_HIGH, NEEDY = 0.2, 0.15, 0.25, 4
#: Cells of half a score window, for its first posts.
CELLS = 16


#: Materialises a frame that is read more than once.
Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def eligible(lib, dimensions: list[str], queued: DataFrame | None = None) -> DataFrame:
    """Canonical, in no open queue, and not yet judged in any of the dimensions."""
    judged = lib.absolute.where(F.col("dimension").isin(*dimensions)).select(F.col("post_id").alias("id"))
    out = lib.posts.where("canonical_post_id IS NULL").join(judged, "id", "left_anti")
    return out if queued is None else out.join(queued.select("id"), "id", "left_anti")


def pairwise_eligible(lib) -> DataFrame:
    """Canonical and on neither side of an open pair."""
    open_ = lib.pair_queue.where("done = 0").select(F.explode(F.array("post_a", "post_b")).alias("id")).distinct()
    return lib.posts.where("canonical_post_id IS NULL").join(open_, "id", "left_anti")


def draw(posts: DataFrame, n: int, seed: int) -> DataFrame:
    return posts.orderBy(shuffle_key(seed), "id").limit(n)


def draw_embedded(lib, posts: DataFrame, n: int, seed: int) -> DataFrame:
    """Twice as many are drawn; those with a vector stay, up to n."""
    drawn = draw(posts, 2 * n, seed)
    return drawn.join(lib.vectors.select(F.col("post_id").alias("id")), "id", "left_semi").orderBy(shuffle_key(seed), "id").limit(n)


def stratified(posts: DataFrame, n: int, seed: int) -> DataFrame:
    """An equal quota of each score 1 to 5, filled up from the rest: strata first, then the shuffled order."""
    quota = max(1, n // 5)
    place = F.row_number().over(Window.partitionBy("score").orderBy(shuffle_key(seed), "id"))
    strata = posts.where(F.col("score").between(1, 5)).withColumn("_n", place).where(F.col("_n") <= quota).select("id", "score", F.lit(0).alias("round"))
    rest = draw(posts.join(strata, "id", "left_anti"), n, seed).select("id", "score", F.lit(1).alias("round"))
    return strata.union(rest).orderBy("round", shuffle_key(seed), "id").limit(n).select("id", "score")


def random_pairs(posts: DataFrame, n: int, seed: int) -> DataFrame:
    """Disjoint pairs: neighbours in the shuffled order of 2n draws."""
    at = draw(posts, 2 * n, seed).withColumn("_n", F.row_number().over(Window.orderBy(shuffle_key(seed), "id")) - 1)
    pair = at.groupBy(F.floor(F.col("_n") / 2).alias("pair")).agg(F.min_by("id", "_n").alias("post_a"), F.max_by("id", "_n").alias("post_b"), F.count("*").alias("n"))
    return pair.where("n = 2").select("pair", "post_a", "post_b")


def first_within(scores: DataFrame, centres: DataFrame, middle: Column, half: float, fits: Column, keep: int, seed: int) -> DataFrame:
    """For each of the distinct centres: its columns with the post_id and score of the first `keep` posts, in shuffled
    order, whose score fits; every row of such a post.

    fits: on score and the centre's columns, true for scores within half of the middle and for no others; rounding at
    the bounds is its own. No window is gone through whole: of equal scores the first `keep` stay, and what lies behind
    the first `keep` of the cells that a window holds for sure can't be among its first. Where order and score have
    nothing to do with each other, that leaves little over `keep` rows for each centre, however many posts a window has.
    """
    width = F.lit(half / CELLS)
    order = F.struct("_key", "post_id")
    first = lambda by: F.dense_rank().over(Window.partitionBy(by).orderBy(order))
    around = lambda c, n: F.explode(F.sequence(F.col(c) - n, F.col(c) + n))
    cell = lambda c: F.floor(c / width).cast("bigint")
    finite = scores.where(F.abs("score") < F.lit(float("inf"))).select("post_id", "score", shuffle_key(seed, "post_id").alias("_key"))
    best = finite.withColumn("_n", first("score")).where(F.col("_n") <= keep).withColumn("_cell", cell(F.col("score"))).drop("_n")
    asked = centres.withColumn("_at", cell(middle))
    cells = asked.select("_at").distinct()
    # the last of the first `keep` posts in the cells that are inside for sure: nothing behind it is needed
    inside = best.withColumn("_n", first("_cell")).where(F.col("_n") <= keep).select("_cell", "_key", "post_id")
    sure = cells.withColumn("_cell", around("_at", CELLS - 2)).join(inside, "_cell").withColumn("_n", first("_at")).where(F.col("_n") <= keep)
    last = sure.groupBy("_at").agg(F.max("_n").alias("_n"), F.max(order).alias("_last")).where(F.col("_n") == keep).drop("_n")
    near = cells.join(last, "_at", "left").withColumn("_cell", around("_at", CELLS + 1)).join(best, "_cell").where(F.col("_last").isNull() | (order <= F.col("_last")))
    found = asked.join(near.select("_at", "post_id", "score", "_key"), "_at").where(fits)
    return found.withColumn("_n", first(centres.columns)).where(F.col("_n") <= keep).drop("_n", "_key", "_at")


def window_candidates(scores: DataFrame, seeds: DataFrame, half: float = WINDOW, keep: int = WINDOW_KEEP, seed: int = 1) -> DataFrame:
    """For each seed (seed_id, centre): posts whose score is within half of its centre, at most `keep` of them.

    Seeds of one centre share its first posts, one more than asked for, as a seed is none of its own.
    """
    centres = seeds.select("centre").where(F.abs("centre") < F.lit(float("inf"))).distinct()
    fits = F.abs(F.col("score") - F.col("centre")) <= F.lit(half)
    found = seeds.join(first_within(scores, centres, F.col("centre"), half, fits, keep + 1, seed), "centre").where(F.col("post_id") != F.col("seed_id"))
    place = F.row_number().over(Window.partitionBy("seed_id").orderBy(shuffle_key(seed, "post_id"), "post_id"))
    return found.withColumn("_n", place).where(F.col("_n") <= keep).select("seed_id", "post_id", "score")


def revisit_pool(pairwise: DataFrame, degrees: DataFrame, cap: int = DEGREE_CAP) -> DataFrame:
    """Posts on either side of a verdict that have comparisons left, fewest first."""
    ends = pairwise.select(F.col("post_a").alias("post_id")).union(pairwise.select(F.col("post_b").alias("post_id"))).distinct()
    return ends.join(degrees, "post_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).where(F.col("degree") < cap).orderBy("degree", "post_id")


def calibration_partners(nodes: DataFrame, scores: DataFrame, per_node: int = 1, seed: int = 1, free: DataFrame | None = None) -> DataFrame:
    """For posts that always won or lost (direction): partners whose score is GAP_LOW to GAP_HIGH further that way.

    Partners come from `free`, scores that may be paired; from all scores unless given. Nodes of one score and direction
    share their first partners, one more than asked for.
    """
    own = scores.select("post_id", F.col("score").alias("own"))
    known = nodes.where("direction <> 0").join(own, "post_id")
    centres = known.select("own", "direction").where(F.abs("own") < F.lit(float("inf"))).distinct()
    gap = (F.col("score") - F.col("own")) * F.col("direction")
    fits = (gap >= F.lit(GAP_LOW)) & (gap <= F.lit(GAP_HIGH))
    target = F.col("own") + F.col("direction") * F.lit((GAP_LOW + GAP_HIGH) / 2)
    partners = first_within(scores if free is None else free, centres, target, (GAP_HIGH - GAP_LOW) / 2, fits, per_node + 1, seed)
    found = known.join(partners.withColumnRenamed("post_id", "partner"), ["own", "direction"]).where(F.col("partner") != F.col("post_id"))
    place = F.row_number().over(Window.partitionBy("post_id").orderBy(shuffle_key(seed, "partner"), "partner"))
    return found.withColumn("_n", place).where(F.col("_n") <= per_node).select(*known.columns, "partner", "score")


# --- whole samplers: one plan each ---------------------------------------------------------------------------------


def near_seeds(lib, seeds: DataFrame, k: int = CLUSTER) -> DataFrame:
    """(place, seed_id, post_id) of each seed and its k nearest posts, without near copies of it.

    seeds: seed_id and place, some tens of rows; their vectors are what is broadcast.
    """
    probes = seeds.join(lib.vectors.select(F.col("post_id").alias("seed_id"), F.col("embedding").alias("v")), "seed_id")
    distance = F.when(F.col("post_id") == F.col("seed_id"), F.lit(0.0)).otherwise(1 - cosine(F.col("embedding"), F.col("v")))
    found = lib.vectors.join(F.broadcast(probes)).select("place", "seed_id", "post_id", distance.alias("distance"))
    first = F.row_number().over(Window.partitionBy("seed_id").orderBy("distance", "post_id"))
    near = found.where("distance IS NOT NULL").withColumn("_n", first).where(F.col("_n") <= k + 1)
    return near.where((F.col("post_id") == F.col("seed_id")) | (F.col("distance") >= MIN_DISTANCE)).select("place", "seed_id", "post_id")


def spent_once(wanted: DataFrame) -> DataFrame:
    """Each post with the earliest seed that wants it."""
    return wanted.groupBy("post_id").agg(F.min(F.struct(*[c for c in wanted.columns if c != "post_id"])).alias("w")).select("post_id", "w.*")


def in_turn(rows: list, fits) -> list[tuple]:
    """Neighbours in the given order that fit, each row in one pair: who finds no partner gives way to the next."""
    waits, out = None, []
    for row in rows:
        if waits is not None and fits(waits, row):
            out.append((waits, row))
            waits = None
        else:
            waits = row
    return out


def _pairs_of_cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """Scored members in score order, no more than one apart; unscored ones among themselves; no near copies."""
    unit = {i: np.asarray(v) / max(float(np.linalg.norm(v)), 1e-12) for i, v in zip(rows["post_id"], rows["embedding"], strict=True)}
    alike = lambda a, b: float(unit[a[1]] @ unit[b[1]]) >= SAME
    scored = sorted((s, i) for s, i in zip(rows["score"], rows["post_id"], strict=True) if s)
    others = sorted((0, i) for s, i in zip(rows["score"], rows["post_id"], strict=True) if not s)
    pairs = in_turn(scored, lambda a, b: b[0] - a[0] <= 1 and not alike(a, b)) + in_turn(others, lambda a, b: not alike(a, b))
    pairs = pairs[:PER_CLUSTER]
    return pd.DataFrame({"place": [int(rows["place"].iloc[0])] * len(pairs), "nth": list(range(len(pairs))), "post_a": [a[1] for a, _ in pairs], "post_b": [b[1] for _, b in pairs]})


def placed(posts: DataFrame, n: int, seed: int) -> DataFrame:
    """seed_id and place of n drawn posts."""
    drawn = draw(posts, n, seed)
    return drawn.select(F.col("id").alias("seed_id"), F.row_number().over(Window.orderBy(shuffle_key(seed), "id")).alias("place"))


def similar_pairs(lib, n: int, seed: int) -> DataFrame:
    """Disjoint pairs of posts that look alike and have scores no more than one apart, from neighbourhoods of drawn seeds."""
    posts = pairwise_eligible(lib)
    seeds = placed(posts, 4 * max(1, -(-n // PER_CLUSTER)), seed)
    members = spent_once(near_seeds(lib, seeds)).join(posts.select(F.col("id").alias("post_id"), "score"), "post_id").join(lib.vectors, "post_id")
    pairs = members.select("place", "post_id", "score", "embedding").groupBy("place").applyInPandas(_pairs_of_cluster, "place int, nth int, post_a long, post_b long")
    return pairs.orderBy("place", "nth").limit(n)


def silva_scores(lib) -> DataFrame:
    """post_id and silva score of posts that may be paired and have a vector."""
    scores = lib.aesthetic.where("scorer = 'silva'").select("post_id", "score")
    return scores.join(pairwise_eligible(lib).select(F.col("id").alias("post_id")), "post_id", "left_semi").join(lib.vectors.select("post_id"), "post_id", "left_semi")


def window_members(lib, judged: DataFrame, n: int, size: int, seed: int, keep: Keep = as_is) -> DataFrame:
    """(place, centre, nth, post_id): for each of n windows around drawn scores up to `size` members that look different.

    judged: pairwise verdicts of one dimension. Posts with DEGREE_CAP comparisons are left out; up to REVISITS that
    have been judged, the least compared first, come before the others.
    """
    degree = win_loss(judged, None).select("post_id", "degree")
    scores = keep(silva_scores(lib).join(degree, "post_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).where(F.col("degree") < DEGREE_CAP))
    seeds = placed(scores.select(F.col("post_id").alias("id")), n, seed).join(scores.select(F.col("post_id").alias("seed_id"), F.col("score").alias("centre")), "seed_id")
    seeds = keep(seeds)
    near = keep(in_windows(scores, seeds))
    again = F.row_number().over(Window.partitionBy("place").orderBy("degree", "post_id"))
    old = near.where("degree > 0").withColumn("_n", again).where(F.col("_n") <= REVISITS).select("post_id", "place", F.lit(0).alias("kind"), "_n")
    drawn = F.row_number().over(Window.partitionBy("place").orderBy(shuffle_key(seed, "post_id"), "post_id"))
    new = near.withColumn("_n", drawn).where(F.col("_n") <= WINDOW_DRAW).select("post_id", "place", F.lit(1).alias("kind"), "_n")
    mine = spent_once(old.union(new))
    kept = F.row_number().over(Window.partitionBy("place", "kind").orderBy("_n"))
    mine = mine.withColumn("_k", kept).where(F.col("_k") <= WINDOW_KEEP)
    given = mine.join(seeds.select("place", "centre"), "place").join(lib.vectors, "post_id").select("place", "centre", "kind", "_n", "post_id", "embedding")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "_n", "post_id"])
        ids = rows["post_id"].tolist()
        chosen = diverse(ids, np.stack(rows["embedding"].tolist()).astype(float), size, first=max(1, int((rows["kind"] == 0).sum())))
        return pd.DataFrame({"place": int(rows["place"].iloc[0]), "centre": float(rows["centre"].iloc[0]), "nth": list(range(len(chosen))), "post_id": chosen})

    return given.groupBy("place").applyInPandas(choose, "place int, centre double, nth int, post_id long")


def in_windows(scores: DataFrame, seeds: DataFrame, half: float = WINDOW) -> DataFrame:
    """Scores inside the seeds' windows (columns centre and others): cells of the window's width make it an equi-join."""
    cell = lambda c: F.floor(F.col(c) / F.lit(half)).cast("bigint")
    near = seeds.withColumn("_cell", F.explode(F.array(cell("centre") - 1, cell("centre"), cell("centre") + 1)))
    found = scores.withColumn("_cell", cell("score")).join(F.broadcast(near), "_cell")  # a batch has some tens of seeds
    return found.where(F.abs(F.col("score") - F.col("centre")) <= F.lit(half)).drop("_cell")


def shown_pairs(judged: DataFrame) -> DataFrame:
    """Pairs that were asked for already, either way round; skipped ones too."""
    return judged.select(F.least("post_a", "post_b").alias("lo"), F.greatest("post_a", "post_b").alias("hi")).distinct()


def unshown(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    keyed = pairs.where("post_a <> post_b").withColumns({"lo": F.least("post_a", "post_b"), "hi": F.greatest("post_a", "post_b")})
    return keyed.join(shown_pairs(judged), ["lo", "hi"], "left_anti").drop("lo", "hi")


def anchors(lib, judged: DataFrame, components: DataFrame, n: int, seed: int) -> DataFrame:
    """(post_id, score) of n posts to tie a batch to: drawn from the ANCHORS least compared of the main component."""
    main = components.join(F.broadcast(main_component(components).select("component")), "component").select(F.col("id").alias("post_id"))
    open_ = win_loss(judged, None).where(F.col("degree") < DEGREE_CAP).join(main, "post_id", "left_semi").orderBy("degree", "post_id").limit(ANCHORS)
    scored = open_.join(lib.aesthetic.where("scorer = 'silva'").select("post_id", "score"), "post_id")
    free = scored.join(pairwise_eligible(lib).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return free.orderBy(shuffle_key(seed, "post_id"), "post_id").limit(n).select("post_id", "score")


def calibration_pairs(lib, judged: DataFrame, components: DataFrame, n: int, seed: int, nodes: DataFrame | None = None) -> DataFrame:
    """(post_a, post_b, score): posts of the main component that always won or lost, the most decided first, each with a
    partner that the model puts clearly beyond it.

    Only the partner must be free to be paired. The first NEEDY * n posts are looked at. nodes: win_loss of judged.
    """
    main = components.join(F.broadcast(main_component(components).select("component")), "component").select(F.col("id").alias("post_id"))
    nodes = win_loss(judged, None) if nodes is None else nodes
    needy = unbounded(nodes).where((F.col("direction") != 0) & (F.col("degree") < DEGREE_CAP)).join(main, "post_id", "left_semi")
    needy = needy.withColumn("decided", F.col("wins") + F.col("losses")).orderBy(F.desc("decided"), "post_id").limit(NEEDY * n)
    scores = lib.aesthetic.where("scorer = 'silva'").select("post_id", "score")
    free = scores.join(pairwise_eligible(lib).select(F.col("id").alias("post_id")), "post_id", "left_semi")
    found = calibration_partners(needy.select("post_id", "direction", "decided"), scores, 1, seed, free)
    pairs = found.select(F.col("post_id").alias("post_a"), F.col("partner").alias("post_b"), F.col("own").alias("score"), "decided")
    once = pairs.groupBy(F.least("post_a", "post_b").alias("lo"), F.greatest("post_a", "post_b").alias("hi")).agg(F.max_by(F.struct(*pairs.columns), F.struct("decided", -F.col("post_a"))).alias("p")).select("p.*")
    return unshown(once, judged).orderBy(F.desc("decided"), "post_a").limit(n).select("post_a", "post_b", "score")


def close_pairs_plan(lib, judged: DataFrame, components: DataFrame, n: int, seed: int, keep: Keep = as_is) -> DataFrame:
    """(position, post_a, post_b): n pairs that the model scores alike, from rings of posts that look different.

    Blocks are rings of score windows, single calibration pairs, and anchors without pairs of their own. They stand in
    score order, each tied to the one before it by a bridge between their first posts, and are dealt out in turns: all
    bridges and first pairs, then all second ones. A pair that was asked for before is left out; its posts are tied
    already. So the pairs, with the history, hang together however early an annotator stops. keep() materialises what
    is read more than once: a batch's members, blocks and pairs, some hundreds of rows, and the components.
    """
    components = keep(components)
    ring = Window.partitionBy("place").orderBy("nth")
    members = keep(window_members(lib, judged, max(1, n // 2), BLOCK, seed, keep))
    size = F.count("*").over(Window.partitionBy("place"))
    around = members.withColumns({"next": F.lead("post_id").over(ring), "head": F.first("post_id").over(ring), "size": size}).where("size > 1")
    # the last closes the ring, unless there are two
    edges = around.select(F.concat(F.lit("w"), "place").alias("block"), F.col("centre").alias("score"), "head", F.col("nth").alias("turn"), F.col("post_id").alias("post_a"), F.coalesce("next", F.when(F.col("size") > 2, F.col("head"))).alias("post_b"))
    single = calibration_pairs(lib, judged, components, max(1, round(n * CALIBRATION_SHARE)), seed).select(F.concat(F.lit("c"), "post_a").alias("block"), "score", F.col("post_a").alias("head"), F.lit(0).alias("turn"), "post_a", "post_b")
    tied = anchors(lib, judged, components, 2, seed).select(F.concat(F.lit("a"), "post_id").alias("block"), "score", F.col("post_id").alias("head"), F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("post_a"), F.lit(None).cast("bigint").alias("post_b"))
    every = keep(edges.union(single).union(tied).where("post_b IS NOT NULL OR post_a IS NULL"))
    # blocks are at most n / 2 windows and some more: one small window puts them in order
    blocks = every.groupBy("block").agg(F.first("score").alias("score"), F.first("head").alias("head"))
    line = Window.orderBy("score", "block")
    blocks = blocks.withColumns({"at": F.row_number().over(line), "before": F.lag("head").over(line)})
    blocks = keep(blocks)
    bridges = blocks.where("before IS NOT NULL").select(F.lit(0).alias("turn"), "at", F.lit(0).alias("kind"), F.col("before").alias("post_a"), F.col("head").alias("post_b"))
    own = every.where("post_a IS NOT NULL").join(blocks.select("block", "at"), "block").select("turn", "at", F.lit(1).alias("kind"), "post_a", "post_b")
    fresh = unshown(bridges.union(own), judged)
    once = fresh.groupBy(F.least("post_a", "post_b").alias("lo"), F.greatest("post_a", "post_b").alias("hi")).agg(F.min(F.struct("turn", "at", "kind", "post_a", "post_b")).alias("p")).select("p.*")
    dealt = once.orderBy("turn", "at", "kind").limit(n)
    return dealt.select((F.row_number().over(Window.orderBy("turn", "at", "kind")) - 1).alias("position"), "post_a", "post_b")


def listwise_groups(lib, judged: DataFrame, n: int, seed: int, size: int = 6, keep: Keep = as_is) -> DataFrame:
    """(place, post_ids): n groups of posts of one score window that look different, in shuffled order of presentation."""
    if not 3 <= size <= 16:
        raise ValueError("a group has 3 to 16 members")
    members = window_members(lib, judged, 2 * n, size, seed, keep)
    order = F.array_sort(F.collect_list(F.struct(shuffle_key(seed, "post_id").alias("k"), "post_id")))
    groups = members.groupBy("place").agg(order.alias("m")).where(F.size("m") >= 3)
    return groups.select("place", F.transform("m", lambda m: m["post_id"]).alias("post_ids")).orderBy("place").limit(n)


def diverse(ids: list[int], vectors: np.ndarray, n: int, same: float = SAME, first: int = 1) -> list[int]:
    """Farthest-point choice: the next one is least like its nearest chosen; stops where that is `same` or more.

    The first ones, up to n, are chosen beforehand.
    """
    if not ids:
        return []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    chosen = list(range(min(first, n, len(ids))))
    near = (unit @ unit[chosen].T).max(1)
    while len(chosen) < min(n, len(ids)):
        left = np.where(np.isin(np.arange(len(ids)), chosen), np.inf, near)
        k = int(left.argmin())
        if left[k] >= same:
            break
        chosen.append(k)
        near = np.maximum(near, unit @ unit[k])
    return [ids[k] for k in chosen]
