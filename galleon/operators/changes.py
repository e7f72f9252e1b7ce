"""Changes to the library as functions from the old state to the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleon.functions.columns import full_path, under
from galleon.operators.filters import BULK_UPDATABLE, UPDATABLE, checked


def update_field(posts: DataFrame, post_id: int, column: str, value) -> DataFrame:
    """A score goes to the group's members as well."""
    hit = F.col("id") == post_id
    if checked(column, UPDATABLE) == "score":
        hit = hit | F.coalesce(F.col("canonical_post_id") == post_id, F.lit(False))
    kind = dict(posts.dtypes)[column]
    return posts.withColumn(column, F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(column)))


def bulk_update(posts: DataFrame, ids: list[int], column: str, value) -> DataFrame:
    kind = dict(posts.dtypes)[checked(column, BULK_UPDATABLE)]
    return posts.withColumn(column, F.when(F.col("id").isin(*ids), F.lit(value).cast(kind)).otherwise(F.col(column)))


def touch(posts: DataFrame, post_id: int, at: Column) -> DataFrame:
    old = F.col("last_accessed_at") if "last_accessed_at" in posts.columns else F.lit(None).cast("timestamp")
    return posts.withColumn("last_accessed_at", F.when(F.col("id") == post_id, at).otherwise(old))


def ungroup(posts: DataFrame, post_id: int) -> DataFrame:
    return posts.withColumn("canonical_post_id", F.when(F.col("id") != post_id, F.col("canonical_post_id")))


def make_canonical(posts: DataFrame, post_id: int) -> DataFrame:
    """The post leads its group: siblings and the old leader point to it. Nothing happens if it leads already."""
    old = posts.where(F.col("id") == post_id).select(F.col("canonical_post_id").alias("_old")).limit(1)
    same = F.col("_old").isNotNull() & ((F.col("canonical_post_id") == F.col("_old")) | (F.col("id") == F.col("_old")))
    new = F.when(F.col("id") == post_id, F.lit(None)).when(same, F.lit(post_id)).otherwise(F.col("canonical_post_id"))
    return posts.join(F.broadcast(old), how="left").withColumn("canonical_post_id", new).select(*posts.columns)


def delete_posts(lib, ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the posts (column id); members of a deleted leader lead themselves.

    Events and queue items go with any of their posts, lists with any of their members.
    """
    gone = ids.select(F.col("id").alias("_gone"))
    left = lib.posts.join(gone, lib.posts["id"] == gone["_gone"], "left_anti")
    lead = left.join(gone, F.col("canonical_post_id") == F.col("_gone"), "left")
    out = {"posts": lead.withColumn("canonical_post_id", F.when(F.col("_gone").isNull(), F.col("canonical_post_id"))).select(*lib.posts.columns)}
    for name in ("waifu", "aesthetic", "post_has_tag", "vectors", "failures"):
        df = getattr(lib, name)
        out[name] = df.join(gone, df["post_id"] == gone["_gone"], "left_anti")
    for name, ends in (("absolute", ["post_id"]), ("flags", ["post_id"]), ("pairwise", ["post_a", "post_b"]), ("listwise", ["m1", "m2", "m3"]), ("absolute_queue", ["post_id"]), ("pair_queue", ["post_a", "post_b"])):
        df = getattr(lib, name)
        for end in ends:
            df = df.join(gone, F.col(end) == F.col("_gone"), "left_anti")
        out[name] = df
    for name in ("rankings", "listwise_queue"):
        df, key = getattr(lib, name), ["id"] if name == "rankings" else ["queue_id", "position"]
        dead = df.select(*key, F.explode(F.from_json("post_ids", "array<bigint>")).alias("_member")).join(gone, F.col("_member") == F.col("_gone"), "left_semi").select(*key).distinct()
        out[name] = df.join(dead, key, "left_anti")
    return out


def deleted_paths(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Files of the posts (column id) that are about to be deleted."""
    return posts.join(ids.select("id"), "id", "left_semi").select("id", full_path().alias("path"))


def create_post(posts: DataFrame, row: dict) -> DataFrame:
    """One more post; score and rating are unset (0) unless given."""
    new = posts.sparkSession.createDataFrame([tuple(({"score": 0, "rating": 0} | row).get(c) for c in posts.columns)], posts.schema)
    return posts.unionByName(new)


def rotate(posts: DataFrame, post_id: int, sha256: str) -> DataFrame:
    """A quarter turn: width and height change places, and the file has a new digest."""
    hit = F.col("id") == post_id
    turned = {"width": F.when(hit, F.col("height")).otherwise(F.col("width")), "height": F.when(hit, F.col("width")).otherwise(F.col("height"))}
    return posts.withColumns(turned | {"sha256": F.when(hit, F.lit(sha256)).otherwise(F.col("sha256"))})


def ensure_groups(groups: DataFrame, names: tuple[str, ...] = ("artist", "character", "copyright", "general", "meta")) -> DataFrame:
    """The canonical tag groups, new ones after the highest id, in order of priority; nothing changes a second time."""
    want = groups.sparkSession.createDataFrame(list(enumerate(names, 1)), "place long, name string").join(groups, "name", "left_anti")
    top = groups.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = want.join(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("place"))).alias("id"), "name")
    return groups.select("id", "name").unionByName(fresh)


def ids_in_folder(posts: DataFrame, folder: str) -> DataFrame:
    """Hidden members included."""
    return posts.where(under(folder)).select("id")


def import_posts(posts: DataFrame, tags: DataFrame, links: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """rows: id, file_path, file_name, extension, source, published_key, rating, tags array<struct<name, group_id>>.

    A known file gets the new source and date and keeps its rating. Of a tag's groups the first one counts; links that
    are there stay as they are. New posts come with their own ids.
    """
    key = ["file_path", "file_name", "extension"]
    fresh = rows.join(posts, key, "left_anti")
    new = rows.select(*key, *[F.col(c).alias(f"_{c}") for c in ("source", "published_key") if c in posts.columns])
    merged = posts.join(new, key, "left")
    for c in ("source", "published_key"):
        if c in posts.columns:
            merged = merged.withColumn(c, F.coalesce(f"_{c}", c))
    state = merged.select(*posts.columns).unionByName(fresh.select(*[c for c in posts.columns if c in fresh.columns]), allowMissingColumns=True)
    each = rows.select("id", *key, F.posexplode("tags").alias("pos", "t")).select("id", *key, "pos", F.col("t.name").alias("name"), F.col("t.group_id").alias("group_id"))
    first = each.groupBy("name").agg(F.min_by("group_id", F.struct("id", "pos")).alias("group_id"))
    known = posts.select(F.col("id").alias("known"), *key)
    wanted = each.join(known, key, "left").select(F.coalesce("known", "id").alias("post_id"), F.col("name").alias("tag_name")).distinct()
    fresh_links = wanted.join(links, ["post_id", "tag_name"], "left_anti").withColumn("is_auto", F.lit(0))
    return {"posts": state, "tags": tags.unionByName(first.join(tags, "name", "left_anti").select(*tags.columns)), "post_has_tag": links.unionByName(fresh_links.select(*links.columns))}


def imported_ids(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Posts with a tag given by hand: rows that merely exist aren't imported."""
    return posts.join(links.where("is_auto = 0").select(F.col("post_id").alias("id")), "id", "left_semi").select("id")


def add_tag(tags: DataFrame, links: DataFrame, post_id: int, name: str, group_id: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(tags, links, whether the link is new)."""
    spark = tags.sparkSession
    one = spark.createDataFrame([(name, group_id)], "name string, group_id int")
    link = spark.createDataFrame([(post_id, name, 0)], "post_id long, tag_name string, is_auto int")
    new = links.where((F.col("post_id") == post_id) & (F.col("tag_name") == name)).isEmpty()
    return tags.unionByName(one.join(tags, "name", "left_anti")), links.unionByName(link.join(links, ["post_id", "tag_name"], "left_anti")), new


def update_tag(tags: DataFrame, name: str, group_id: int | None) -> DataFrame:
    """The tag in another group; an unknown tag changes nothing."""
    return tags.withColumn("group_id", F.when(F.col("name") == name, F.lit(group_id).cast("int")).otherwise(F.col("group_id")))


def delete_tags(tags: DataFrame, links: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    return tags.where(~F.col("name").isin(*names)), links.where(~F.col("tag_name").isin(*names))


def count_changes(counts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept tag counts after links of canonical posts came and went: deltas per tag, one join."""
    delta = added.select("tag_name", F.lit(1).alias("d")).union(removed.select("tag_name", F.lit(-1).alias("d"))).groupBy(F.col("tag_name").alias("name")).agg(F.sum("d").alias("d"))
    return counts.join(delta, "name", "full").select("name", "group_id", (F.coalesce("post_count", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("post_count"))


def outside(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose file_path is neither one of the folders (file_path) nor below one; "." holds all."""
    paths = rows.select("file_path").distinct()
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("file_path", F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), above))).alias("above"))
    under_one = each.join(folders.select(F.col("file_path").alias("above")).distinct(), "above", "left_semi").select("file_path")
    return rows.join(under_one, "file_path", "left_anti")


def reconcile(on_disk: DataFrame, posts: DataFrame, failed: list[str] | DataFrame | None = None, allow_mass_delete: bool = False, floor: int = 100, share: float = 0.5) -> tuple[DataFrame, DataFrame, bool]:
    """(new files, rows to delete, whether the deletion was held back).

    Rows under directories that couldn't be read are exempt. Deleting more than half of at least 100 rows is held
    back unless allowed. Keys are (file_path, file_name, extension). failed: folders, or a frame of them (file_path).
    """
    key = ["file_path", "file_name", "extension"]
    null_safe = lambda a, b: [a[c].eqNullSafe(b[c]) for c in key]
    new = on_disk.join(posts, null_safe(on_disk, posts), "left_anti")
    lost = posts.join(on_disk, null_safe(posts, on_disk), "left_anti")
    if isinstance(failed, DataFrame):
        lost = outside(lost, failed).select(*posts.columns)
        failed = None
    for folder in failed or []:
        lost = lost.limit(0) if folder == "." else lost.where(~under(folder))
    total, gone = posts.count(), lost.count()
    held = total >= floor and gone > share * total and not allow_mass_delete
    return new, lost.limit(0) if held else lost, held

