"""Near-duplicate grouping of vectors: lexicographically first canonicals over exact near pairs, regrouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleon.functions.columns import norm
from galleon.operators.metric import near_pairs

THRESHOLD = 0.01
#: So many open edges are settled in one task; more are in rounds.
FEW = 500_000


def export_vectors(lib) -> DataFrame:
    """Vectors of posts that exist, by id; vectors of another width than the rest are an error."""
    kept = lib.vectors.join(lib.posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    dim = kept.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in width")).cast("array<float>"))
    return kept.join(F.broadcast(dim)).select("post_id", same.alias("embedding")).orderBy("post_id")


def first_set(edges: DataFrame) -> DataFrame:
    """(id) of the first maximal independent set in id order, in one task: for bounded numbers of edges a < b."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, members = set(), set()
        for x in batches:
            for b, a in zip(x.column("b").to_pylist(), x.column("a").to_pylist(), strict=True):
                ends.update((a, b))
                if a not in members:  # edges come by b, so what is smaller is settled
                    members.add(b)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(ends - members), pa.int64())], names=["id"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).sortWithinPartitions("b", "a").mapInArrow(step, "id long")


def assign_canonicals(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None, few: int = FEW) -> DataFrame:
    """(member, canonical): the first maximal independent set in id order, each member with its least canonical.

    A node without smaller neighbours that may still become canonical is canonical; neighbours of canonicals are
    members. Each round decides every node whose smaller neighbours are decided, the least open one at any rate, until
    at most `few` edges are open; one task settles these in order, as chains would take a round for every two nodes.
    """
    keep = keep or (lambda df: df.checkpoint())
    edges = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))  # a pair may come twice
    open_, seeds, rounds = edges, None, 0
    while (left := open_.limit(few + 1).count()) > few:
        blocked = open_.select(F.col("b").alias("id")).distinct()
        new = keep(open_.select(F.col("a").alias("id")).distinct().join(blocked, "id", "left_anti"))
        seeds, rounds = new if seeds is None else seeds.union(new), rounds + 1
        if rounds % 20 == 0:
            seeds = keep(seeds)
        members = open_.join(new.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        gone = keep(members.union(new).distinct())
        open_ = open_.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        # a node all of whose edges went without its being decided has no neighbour left: it is canonical alone
        open_ = keep(open_)
    if left:
        last = keep(first_set(open_))
        seeds = last if seeds is None else seeds.union(last)
    if seeds is None:
        return edges.select(F.col("b").alias("member"), F.col("a").alias("canonical")).limit(0)
    free = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(seeds, "id", "left_anti")
    # nodes that lost all open edges to members are canonical too, unless a canonical is beside them
    by_seed = edges.join(seeds.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
    both = seeds.union(free.join(by_seed, "id", "left_anti"))
    return edges.join(both.withColumnRenamed("id", "a"), "a").join(both.withColumnRenamed("id", "b"), "b", "left_anti").groupBy(F.col("b").alias("member")).agg(F.min("a").alias("canonical"))


def replace_groups(posts: DataFrame, assignment: DataFrame) -> DataFrame:
    """Posts with the new pointers only; canonicals that are gone are skipped."""
    live = assignment.join(posts.select(F.col("id").alias("canonical")), "canonical", "left_semi")
    new = live.select(F.col("member").alias("id"), F.col("canonical").alias("_new"))
    return posts.drop("canonical_post_id").join(new, "id", "left").withColumnRenamed("_new", "canonical_post_id").select(*posts.columns)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(post_id, rep): posts with the same vector have the one with the smallest id as representative."""
    least = vectors.groupBy("embedding").agg(F.min("post_id").alias("rep"))
    return vectors.join(least, "embedding").select("post_id", "rep")


def grouped_vectors(vectors: DataFrame, threshold: float = THRESHOLD, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(member, canonical) of all posts near another, without a pair for every two of a class of equal vectors.

    Equal vectors are near the same others. So representatives are compared alone: the rest of a class follows its
    representative to its canonical, or has it as canonical. That is what all pairs would give. A zero vector is near none.
    """
    keep = keep or (lambda df: df.checkpoint())
    classes = keep(vector_classes(vectors.where(norm(F.col("embedding")) > 0)))
    own = classes.where("post_id = rep").select("post_id")
    assigned = keep(assign_canonicals(near_pairs(vectors.join(own, "post_id", "left_semi"), threshold, keep), keep))
    rest = classes.where("post_id <> rep").join(assigned.withColumnRenamed("member", "rep"), "rep", "left")
    return assigned.unionByName(rest.select(F.col("post_id").alias("member"), F.coalesce("canonical", "rep").alias("canonical")))


def rebuild_groups(lib, threshold: float = THRESHOLD, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The posts regrouped; with fewer than two vectors all groups are cleared."""
    return replace_groups(lib.posts, grouped_vectors(export_vectors(lib), threshold, keep))
