"""Counts, facets, statistics and folder roll-ups over filtered posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleon.functions.columns import contains_ci
from galleon.functions.scoring import LUNA, SCORERS, SILVA, WAIFU
from galleon.operators.filters import GROUPABLE, PostFilter, apply_filter, checked


def count_posts(lib, f: PostFilter) -> DataFrame:
    return apply_filter(lib, f).agg(F.count("id").alias("n"))


def count_by_column(lib, column: str, f: PostFilter) -> DataFrame:
    return apply_filter(lib, f).groupBy(checked(column, GROUPABLE)).agg(F.count("id").alias("n"))


def count_by_bucket(lib, scorer: str, f: PostFilter) -> DataFrame:
    """Buckets without posts are absent."""
    s = SCORERS[scorer]
    return s.join(apply_filter(lib, f), lib.waifu, lib.aesthetic).groupBy(s.bucket().alias("bucket")).agg(F.count("*").alias("n"))


def facet_share(counts: DataFrame) -> DataFrame:
    """Each count's share of all, in per cent to one decimal; the counts are few, one row per value."""
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 1)).otherwise(0.0))


def overall_stats(lib, f: PostFilter) -> DataFrame:
    """One pass; averages leave out unset scores (0) and are null for none."""
    posts = WAIFU.join(apply_filter(lib, f), lib.waifu, lib.aesthetic)
    scored = F.when(F.col("score") > 0, F.col("score"))
    return posts.agg(F.count("*").alias("total"), F.round(F.avg(scored), 6).alias("avg_score"), F.count(scored).alias("scored_count"), F.round(F.avg("waifu_score"), 6).alias("avg_waifu"), F.count("waifu_score").alias("waifu_count"))


def rating_distribution(lib, f: PostFilter) -> DataFrame:
    return apply_filter(lib, f).groupBy(F.coalesce("rating", F.lit(0)).alias("rating")).agg(F.count("*").alias("n"))


def tag_counts(lib) -> DataFrame:
    """The table kept beside the tags: canonical posts of each tag, 0 for none."""
    live = lib.post_has_tag.join(lib.posts.where("canonical_post_id IS NULL").select(F.col("id").alias("post_id")), "post_id", "left_semi")
    counts = live.groupBy(F.col("tag_name").alias("name")).agg(F.count("*").alias("post_count"))
    return lib.tags.join(counts, "name", "left").select("name", "group_id", F.coalesce("post_count", F.lit(0)).cast("bigint").alias("post_count"))


def tag_facet(lib, f: PostFilter, query: str | None = None, extra: list[str] | None = None, limit: int | None = 50, kept: DataFrame | None = None) -> DataFrame:
    """Posts of each tag, most first. Without content filters the kept counts are read, else links are counted."""
    if not f.active() and f.only_canonical:
        counts = (tag_counts(lib) if kept is None else kept).select("name", F.col("post_count").alias("n")).where("n > 0")
    else:
        counts = lib.post_has_tag.join(apply_filter(lib, f).select(F.col("id").alias("post_id")), "post_id", "left_semi").groupBy(F.col("tag_name").alias("name")).agg(F.count("*").alias("n"))
    if query:
        match = contains_ci(F.col("name"), query)
        counts = counts.where(match | F.col("name").isin(*extra) if extra else match)
    counts = counts.orderBy(F.desc("n"), "name")
    return counts.limit(limit) if limit else counts


def waifu_histogram(lib) -> DataFrame:
    """Ten bins of width 1, all present; 10.0 falls into the last."""
    bins = lib.waifu.groupBy(F.least(F.floor("score"), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))
    every = lib.waifu.sparkSession.range(10).withColumnRenamed("id", "bin")
    return every.join(bins, "bin", "left").select("bin", F.concat(F.col("bin").cast("string"), F.lit("~"), (F.col("bin") + 1).cast("string")).alias("label"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


SUMS = ("posts", "score_sum", "score_n", "rating_sum", "silva_sum", "silva_n", "luna_sum", "luna_n")


def folder_sums(lib) -> DataFrame:
    """Sums per folder, canonical or not; unset scores are left out, ratings count for all posts."""
    posts = LUNA.join(SILVA.join(lib.posts, lib.waifu, lib.aesthetic), lib.waifu, lib.aesthetic)
    score = F.when(F.col("score") > 0, F.col("score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return posts.groupBy("file_path").agg(
        F.count("*").alias("posts"), zero(F.sum(score)).cast("bigint").alias("score_sum"), F.count(score).alias("score_n"), F.sum("rating").cast("bigint").alias("rating_sum"),
        F.coalesce(F.sum("silva_score"), F.lit(0.0)).alias("silva_sum"), F.count("silva_score").alias("silva_n"), F.coalesce(F.sum("silva_luna_score"), F.lit(0.0)).alias("luna_sum"), F.count("silva_luna_score").alias("luna_n"),
    )


def _averages() -> list[Column]:
    def over(a: str, b: str, name: str) -> Column:
        return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).alias(name)

    return [over("score_sum", "score_n", "score_avg"), over("rating_sum", "posts", "rating_avg"), over("silva_sum", "silva_n", "silva_avg"), over("luna_sum", "luna_n", "luna_avg")]


def folder_direct(lib) -> DataFrame:
    return folder_sums(lib).select("file_path", "posts", *_averages())


def folder_rollup(lib) -> DataFrame:
    """Every folder with what is below it; '.' has all. Sums per folder first, then their path prefixes."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    prefixes = F.when(F.col("file_path") == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), above))
    return folder_sums(lib).withColumn("folder", F.explode(prefixes)).groupBy("folder").agg(*[F.sum(c).alias(c) for c in SUMS]).select("folder", "posts", *_averages())


def selection_stats(posts: DataFrame) -> DataFrame:
    """What a selection has in common: dimensions, distributions by clamped value, the shared part of the folders."""
    def common(name: str) -> Column:
        return F.when(F.min(name) == F.max(name), F.min(name)).alias(f"common_{name}")

    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    low, high = F.split(F.min("file_path"), "/"), F.split(F.max("file_path"), "/")
    # the least and the greatest path agree on just what all paths share
    agreed = F.aggregate(
        F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n")), lambda s: s["n"],
    )
    dist = [F.count_if(F.least(F.greatest(F.coalesce("rating", F.lit(0)), F.lit(0)), F.lit(4)) == k).alias(f"rating_{k}") for k in range(5)]
    dist += [F.count_if(F.least(F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)), F.lit(5)) == k).alias(f"score_{k}") for k in range(6)]
    return posts.agg(F.count("*").alias("n"), *dist, F.min(positive("width")).alias("min_width"), F.max(positive("width")).alias("max_width"), F.min(positive("height")).alias("min_height"), F.max(positive("height")).alias("max_height"), common("rating"), common("score"), common("extension"), F.array_join(F.slice(low, 1, agreed), "/").alias("common_folder"))


def selection_extensions(posts: DataFrame) -> DataFrame:
    """Extensions of a selection in lower case with counts and pixels, most first: one row per extension."""
    pixels = F.sum(F.greatest(F.coalesce("width", F.lit(0)), F.lit(0)).cast("bigint") * F.greatest(F.coalesce("height", F.lit(0)), F.lit(0)))
    return posts.groupBy(F.lower("extension").alias("extension")).agg(F.count("*").alias("n"), pixels.alias("pixels")).orderBy(F.desc("n"), "extension")


def extension_tally(posts: DataFrame) -> DataFrame:
    return posts.groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension")
