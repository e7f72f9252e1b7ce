"""What each enrichment pipeline still has to do, and how its results are taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleon.functions.columns import is_image

#: Ratings as the tagger names them, and groups in order of priority.
TAGGER_RATINGS = {"general": 1, "sensitive": 2, "questionable": 3, "explicit": 4}
GROUPS = ("artist", "character", "copyright", "general", "meta")


def _ids(df: DataFrame, column: str = "post_id") -> DataFrame:
    return df.select(F.col(column).alias("id"))


def _open(posts: DataFrame, failures: DataFrame, worker: str) -> DataFrame:
    return posts.join(_ids(failures.where(F.col("worker") == worker)), "id", "left_anti")


def pending_scorer(lib, scorer: str) -> DataFrame:
    """Posts with a vector and without this scorer's score."""
    todo = lib.posts.join(_ids(lib.vectors), "id", "left_semi").join(_ids(lib.aesthetic.where(F.col("scorer") == scorer)), "id", "left_anti")
    return _open(todo, lib.failures, scorer).select("id")


def pending_waifu(lib) -> DataFrame:
    return _open(lib.posts.where(is_image()).join(_ids(lib.waifu), "id", "left_anti"), lib.failures, "waifu").select("id")


def pending_tagger(lib) -> DataFrame:
    return _open(lib.posts.where(is_image()).join(_ids(lib.post_has_tag.where("is_auto = 1")), "id", "left_anti"), lib.failures, "tagger").select("id")


def pending_embedding(lib) -> DataFrame:
    return _open(lib.posts.where(is_image()).join(_ids(lib.vectors), "id", "left_anti"), lib.failures, "embedding:siglip2").select("id")


def pending_basics(lib) -> DataFrame:
    has = [(F.col("sha256") != "").alias("has_sha256"), F.col("lab_l").isNotNull().alias("has_colour")]
    todo = lib.posts.where(is_image() & ((F.col("sha256") == "") | F.col("lab_l").isNull()))
    return _open(todo, lib.failures, "basics").select("id", *has)


# --- taking results in: functions from state and results to the new state ----------------------------------------


def upsert(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones; of several new rows of a key the last by `seq`, if there is one, counts."""
    if "seq" in new.columns:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where("_n = 1").drop("_n", "seq")
    return state.join(new.select(*keys), keys, "left_anti").select(*state.columns).unionByName(new.select(*state.columns))


def upsert_vectors(lib, new: DataFrame) -> DataFrame:
    """Vectors of posts that are gone meanwhile are left out."""
    return upsert(lib.vectors, new.join(lib.posts.select(F.col("id").alias("post_id")), "post_id", "left_semi"), ["post_id"])


def record_failures(failures: DataFrame, new: DataFrame) -> DataFrame:
    """The first failure of a post and worker stays."""
    return failures.unionByName(new.join(failures, ["post_id", "worker"], "left_anti").dropDuplicates(["post_id", "worker"]).select(*failures.columns))


def upsert_basics(posts: DataFrame, new: DataFrame) -> DataFrame:
    """Filled fields replace old ones, empty ones keep them; a colour that is there stays."""
    n = new.select("id", F.col("sha256").alias("n_sha"), F.col("width").alias("n_w"), F.col("height").alias("n_h"), *[F.col(c).alias(f"n_{c}") for c in ("lab_l", "lab_a", "lab_b")])
    j = posts.join(n, "id", "left")
    values = {"sha256": F.coalesce("n_sha", "sha256"), "width": F.coalesce("n_w", "width"), "height": F.coalesce("n_h", "height")} | {c: F.coalesce(c, f"n_{c}") for c in ("lab_l", "lab_a", "lab_b")}
    return j.withColumns(values).select(*posts.columns)


def tagger_links(links: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, shadowed): automatic links are added where there is none; posts all of whose tags were there are shadowed."""
    new = results.select("post_id", F.explode("tags").alias("tag_name")).distinct()
    fresh = new.join(links, ["post_id", "tag_name"], "left_anti").withColumn("is_auto", F.lit(1))
    shadowed = results.select("post_id").join(fresh, "post_id", "left_anti").join(links.where("is_auto = 1"), "post_id", "left_anti")
    return links.unionByName(fresh.select(*links.columns)), shadowed


def tagger_rating(posts: DataFrame, results: DataFrame, guarded: bool = True) -> DataFrame:
    """Guarded: only where the rating is unset; else always. Unknown names are 0."""
    names = F.create_map(*[F.lit(x) for kv in TAGGER_RATINGS.items() for x in kv])
    n = results.select(F.col("post_id").alias("id"), F.coalesce(F.try_element_at(names, F.col("rating")), F.lit(0)).alias("n_rating"))
    new = F.when(F.col("n_rating").isNotNull() & ((F.col("rating") == 0) | F.lit(not guarded)), F.col("n_rating")).otherwise(F.col("rating"))
    return posts.join(n, "id", "left").withColumn("rating", new.cast("int")).select(*posts.columns)


def tagger_groups(tags: DataFrame, seen: DataFrame) -> DataFrame:
    """New names come with their group; known ones get it only where they have none."""
    first = seen.groupBy("name").agg(F.min("group_id").alias("n_group"))
    return tags.join(first, "name", "full").select("name", F.coalesce("group_id", "n_group").alias("group_id"))


def backlog(lib) -> DataFrame:
    """Per pipeline: images, done and open ones, and the share that is done in per cent, to one decimal."""
    images = lib.posts.where(is_image())
    has = {
        "waifu": images.join(_ids(lib.waifu), "id", "left_semi"),
        "tagger": images.join(_ids(lib.post_has_tag.where("is_auto = 1")), "id", "left_semi"),
        "embedding": images.join(_ids(lib.vectors), "id", "left_semi"),
        "basics": images.where("sha256 <> '' AND lab_l IS NOT NULL"),
    }
    open_ = {"waifu": pending_waifu(lib), "tagger": pending_tagger(lib), "embedding": pending_embedding(lib), "basics": pending_basics(lib)}
    rows = images.select(F.explode(F.array(*map(F.lit, has))).alias("pipeline"), F.lit(1).alias("images"), F.lit(0).alias("done"), F.lit(0).alias("todo"))
    for name in has:
        rows = rows.union(has[name].select(F.lit(name), F.lit(0), F.lit(1), F.lit(0))).union(open_[name].select(F.lit(name), F.lit(0), F.lit(0), F.lit(1)))
    sums = rows.groupBy("pipeline").agg(*[F.sum(c).alias(c) for c in ("images", "done", "todo")])
    return sums.withColumn("pct", F.when(F.col("images") > 0, F.round(F.col("done") * 100.0 / F.col("images"), 1)).otherwise(0.0))


class ScanGate:
    """Skips a scan for open posts while the greatest post id stays what it was when the last scan found none."""

    def __init__(self) -> None:
        self.empty_at: int | None = None

    def scan(self, posts: DataFrame, todo: DataFrame) -> DataFrame | None:
        """The open posts, or None if nothing can have come since the last, empty scan."""
        top = posts.agg(F.max("id")).first()[0]
        if self.empty_at is not None and top == self.empty_at:
            return None
        self.empty_at = top if todo.isEmpty() else None
        return todo


def basics(files: DataFrame) -> DataFrame:
    """Digest and size of file contents (columns id, content): the part of the basics that needs no image decoder."""
    return files.select("id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"))


def palette_entries(palettes: DataFrame) -> DataFrame:
    """(id, position, colour) of palettes (id, colours): a palette replaces the old one whole, so an empty one is left out."""
    return palettes.where(F.size("colours") > 0).select("id", F.posexplode("colours").alias("position", "colour"))


def replace_palettes(state: DataFrame, new: DataFrame) -> DataFrame:
    """state: (id, position, colour). Posts with a new palette lose all their old entries."""
    fresh = palette_entries(new)
    return state.join(fresh.select("id").distinct(), "id", "left_anti").select(*state.columns).unionByName(fresh.select(*state.columns))


def fresh_within(when: str, days: int, now) -> Column:
    """Whether a time lies at most so many days before now; unknown times count as stale."""
    return F.coalesce(F.datediff(F.to_date(now), F.to_date(when)).between(0, days), F.lit(False))
