"""Sorted, paged and nested reads: column, score, shuffled and colour order, keyset pages, details, vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galleon.functions.columns import aspect_ratio, cosine, full_path, l2, match_probability, shuffle_key
from galleon.functions.scoring import LUNA, SILVA, WAIFU, in_stars
from galleon.operators.filters import ORDERABLE, PostFilter, apply_filter, checked

SIMPLE = ("id", "file_path", "file_name", "extension", "width", "height", "score", "rating")
VIRTUAL = {"waifu_score": WAIFU, "silva_score": SILVA, "silva_luna_score": LUNA}
GROUP_ORDER = ("artist", "copyright", "character", "general", "meta")


def discrepancy() -> Column:
    """How far the model's score, on the 1-5 scale, is from the given one; null where either is unset."""
    return F.when((F.col("score") >= 1) & F.col("silva_score").isNotNull(), F.abs(in_stars(F.col("silva_score")) - F.col("score")))


def ordered(lib, posts: DataFrame, by: str = "id", direction: str = "desc") -> tuple[DataFrame, list[Column]]:
    """The posts with what the order needs, and the order: only 'asc' ascends, ties go by id the same way."""
    checked(by, ORDERABLE)
    up = direction == "asc"
    tie = F.asc("id") if up else F.desc("id")
    if by in VIRTUAL or by == "discrepancy":
        posts = (SILVA if by == "discrepancy" else VIRTUAL[by]).join(posts, lib.waifu, lib.aesthetic)
        if by == "discrepancy":
            posts = posts.withColumn("discrepancy", discrepancy())
        return posts, [F.asc_nulls_last(by) if up else F.desc_nulls_last(by), tie]
    key = F.asc_nulls_first(by) if up else F.desc_nulls_last(by)
    return posts, [key] if by == "id" else [key, tie]


def search(lib, f: PostFilter, by: str = "id", direction: str = "desc", limit: int = 200, offset: int = 0, seed: int | None = None, resort: str | None = None, resort_direction: str = "desc") -> DataFrame:
    """One page with its position. lab in the filter orders by colour distance, before all else; 'random' shuffles."""
    posts, extra = apply_filter(lib, f), []
    if f.lab:
        want = F.array(*[F.lit(float(v)) for v in f.lab])
        posts = posts.where("lab_l IS NOT NULL AND lab_a IS NOT NULL AND lab_b IS NOT NULL").withColumn("distance", l2(F.array("lab_l", "lab_a", "lab_b"), want))
        order, extra = [F.asc("distance"), F.asc("id")], ["distance"]
    elif direction == "random":
        posts = posts.withColumn("shuffle", shuffle_key(seed))
        order, extra = [F.asc("shuffle"), F.asc("id")], []
        if resort:  # the page is cut in shuffled order and shown in another
            posts, after = ordered(lib, posts, resort, resort_direction)
            page = posts.orderBy(*order).offset(offset).limit(limit)
            return page.orderBy(F.asc_nulls_last(resort) if resort_direction == "asc" else F.desc_nulls_last(resort), *after[1:])
    else:
        posts, order = ordered(lib, posts, by, direction)
        extra = [by] if by in VIRTUAL or by == "discrepancy" else []
    page = posts.orderBy(*order).offset(offset) if offset else posts.orderBy(*order)
    return page.limit(limit).select(*SIMPLE, *extra)


def keyset_page(lib, start: int, limit: int) -> DataFrame:
    """Canonical posts from an id on, and one row more, flagged: its id is the next page's start."""
    page = lib.posts.where((F.col("id") >= start) & F.col("canonical_post_id").isNull()).orderBy("id").limit(limit + 1)
    last = F.row_number().over(_by_id()) > limit
    return page.select("id", last.alias("is_next"))


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("id")  # over a page: at most limit + 1 rows


def tags_page(counts: DataFrame, after: str | None, limit: int) -> DataFrame:
    page = counts if after is None else counts.where(F.col("name") > after)
    return page.orderBy("name").limit(limit).select("name", "post_count")


def in_given_order(posts: DataFrame, ids: list[int], canonical: bool = False) -> DataFrame:
    """Posts in the order of the ids, a page of them; missing ones drop out."""
    wanted = posts.sparkSession.createDataFrame([(i, p) for p, i in enumerate(ids)], "id long, pos int")
    found = posts.where("canonical_post_id IS NULL") if canonical else posts
    return found.join(F.broadcast(wanted), "id").orderBy("pos")


def member_counts(posts: DataFrame) -> DataFrame:
    return posts.where("canonical_post_id IS NOT NULL").groupBy(F.col("canonical_post_id").alias("id")).agg(F.count("*").alias("members"))


def tag_rank() -> Column:
    out = F.lit(len(GROUP_ORDER))
    for k, name in reversed(list(enumerate(GROUP_ORDER))):
        out = F.when(F.col("group_name") == name, k).otherwise(out)
    return out


def details(lib, posts: DataFrame) -> DataFrame:
    """Nested read model: posts with their tags (by group, then name), scores and number of members, in one plan.

    What belongs to the posts is picked by their ids before anything is grouped.
    """
    mine = posts.select("id")
    groups = lib.tag_groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    links = lib.post_has_tag.join(mine.withColumnRenamed("id", "post_id"), "post_id", "left_semi")
    tags = links.join(lib.tags.select(F.col("name").alias("tag_name"), "group_id"), "tag_name").join(groups, "group_id", "left").withColumn("rank", tag_rank())
    listed = tags.groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("tag_name").alias("name"), "group_name", "is_auto"))).alias("tags"))
    scores = lib.aesthetic.join(mine.withColumnRenamed("id", "post_id"), "post_id", "left_semi").groupBy(F.col("post_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("scorer", "score"))).alias("aesthetic"))
    led = lib.posts.join(mine.withColumnRenamed("id", "canonical_post_id"), "canonical_post_id", "left_semi")
    out = WAIFU.join(posts, lib.waifu, lib.aesthetic).join(listed, "id", "left").join(scores, "id", "left").join(member_counts(led), "id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    return out.select(*SIMPLE, "canonical_post_id", full_path().alias("full_path"), aspect_ratio().alias("aspect_ratio"), "waifu_score", empty("tags"), empty("aesthetic"), F.coalesce("members", F.lit(0)).cast("bigint").alias("members"))


def fetch_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the given posts (column id); those without one are absent."""
    return vectors.join(ids.select(F.col("id").alias("post_id")), "post_id", "left_semi")


def knn(vectors: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """post_id and cosine distance of the k nearest; probe: one row with a column v. Ties go by post_id."""
    one = probe.select("v").limit(1)
    near = vectors.join(F.broadcast(one)).select("post_id", (1 - cosine(F.col("embedding"), F.col("v"))).alias("distance"))
    return near.where("distance IS NOT NULL").orderBy("distance", "post_id").limit(k)


def knn_of(vectors: DataFrame, post_id: int, k: int) -> DataFrame:
    """The nearest of a post, itself included; nothing if it has no vector."""
    return knn(vectors, vectors.where(F.col("post_id") == post_id).select(F.col("embedding").alias("v")), k)


def similar_posts(lib, post_id: int, limit: int) -> DataFrame:
    """k is cut before hidden members are dropped, so fewer than limit may come back."""
    near = knn_of(lib.vectors, post_id, limit + 1).where(F.col("post_id") != post_id).limit(limit)
    live = lib.posts.where("canonical_post_id IS NULL").select(F.col("id").alias("post_id"))
    return near.join(live, "post_id", "left_semi").select("post_id", "distance", (1 - F.col("distance")).alias("match_prob"))


def text_search(lib, vector: list[float], f: PostFilter, limit: int, offset: int = 0, scale: float = 100.0, bias: float = -10.0) -> DataFrame:
    """Nearest to a query vector: at least 1000 are taken, then filtered, then paged."""
    spark = lib.posts.sparkSession
    near = knn(lib.vectors, spark.createDataFrame([(list(map(float, vector)),)], "v array<double>"), max(limit + offset, 1000))
    found = near.join(apply_filter(lib, f).select(F.col("id").alias("post_id")), "post_id", "left_semi").orderBy("distance", "post_id")
    found = found.offset(offset) if offset else found
    return found.limit(limit).withColumn("probability", match_probability(1 - F.col("distance"), scale, bias))
