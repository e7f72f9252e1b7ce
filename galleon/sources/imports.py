"""Import sources: booru listings and multi-site metadata, validated and brought into one row shape."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from galleon.functions.columns import tag_words

#: Groups in order of priority, extensions that are taken, rating names of the two importers.
GROUP_IDS = {"artist": 1, "character": 2, "copyright": 3, "general": 4, "meta": 5}
TAKEN = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
WORD_RATINGS = {"general": 1, "safe": 1, "sensitive": 2, "questionable": 3, "explicit": 4}
LETTER_RATINGS = {"g": 1, "s": 2, "q": 3, "e": 4}
LISTING = "id long, created_at string, source string, rating string, file_ext string, file_url string, tag_string_artist string, tag_string_character string, tag_string_copyright string, tag_string_general string, tag_string_meta string, _corrupt_record string"


def pages(fetch: Callable[[int | None, int], list[dict]], limit: int, page: int = 200, stop: Callable[[list[dict]], bool] | None = None) -> Iterator[dict]:
    """Rows in pages of descending ids: the next page is before the least raw id; ends on an empty or short page."""
    before, left = None, limit
    while left > 0:
        rows = fetch(before, min(page, left))
        yield from rows
        left -= len(rows)
        if not rows or len(rows) < min(page, left + len(rows)) or (stop and stop(rows)):
            return
        before = min(r["id"] for r in rows if "id" in r)


class ListingReader(DataSourceReader):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = path, limit

    def read(self, partition) -> Iterator[tuple]:
        import json

        with open(self.path, encoding="utf-8") as f:
            rows = sorted(json.load(f), key=lambda r: -r.get("id", 0))
        ids = [-r.get("id", 0) for r in rows]

        def fetch(before: int | None, n: int) -> list[dict]:
            start = 0 if before is None else bisect.bisect_right(ids, -before)
            return rows[start : start + n]

        for r in pages(fetch, self.limit):
            yield (json.dumps(r),)


class ListingSource(DataSource):
    """Offline listing: a JSON file of posts, read in keyset pages as the site gives them."""

    @classmethod
    def name(cls) -> str:
        return "booru_listing"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("limit", "1000000")))


def listing(spark: SparkSession, path: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of a listing; malformed ones drop out, the rest of their page stays."""
    spark.dataSource.register(ListingSource)
    raw = spark.read.format("booru_listing").option("limit", limit).load(path)
    rows = raw.select(F.from_json("value", LISTING, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")


def importable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("file_url").isNotNull() & (F.col("file_url") != "") & F.lower("file_ext").isin(*TAKEN))


def not_imported(rows: DataFrame, imported: DataFrame) -> DataFrame:
    return rows.join(imported.select("id"), "id", "left_anti")


def grouped_tags(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """tags: array of (name, group_id), each name once, under the first group in order of priority."""
    def under(group: int, column: str) -> Column:
        return F.transform(tag_words(F.coalesce(F.col(column), F.lit(""))), lambda t: F.struct(t.alias("name"), F.lit(group).alias("group_id")))

    parts = [under(GROUP_IDS[g], c) for g, c in columns.items()]
    every = F.concat(*parts)
    once = F.aggregate(every, F.array().cast("array<struct<name:string,group_id:int>>"), lambda have, t: F.when(F.exists(have, lambda h: h["name"] == t["name"]), have).otherwise(F.concat(have, F.array(t))))
    return rows.withColumn("tags", once)


def listing_tags(rows: DataFrame) -> DataFrame:
    return grouped_tags(rows, {g: f"tag_string_{g}" for g in GROUP_IDS})


def rating_of(column: Column, letters: bool) -> Column:
    """Full words everywhere; single letters only for the multi-site path. Anything else is unset (0)."""
    names = WORD_RATINGS | (LETTER_RATINGS if letters else {})
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(column)), F.lit(0))


def resolve_source(source: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), fallback)


META = "array<string>"


def site_entries(spark: SparkSession, path: str) -> DataFrame:
    """Messages [3, url, metadata] of an extractor's JSON; other messages and broken input give nothing."""
    text = spark.read.text(path, wholetext=True)
    messages = text.select(F.explode_outer(F.from_json("value", META)).alias("m")).select(F.from_json("m", META).alias("m"))
    return messages.where((F.size("m") == 3) & (F.col("m")[0] == "3")).select(F.col("m")[1].alias("url"), F.col("m")[2].alias("meta"))


def parse_entries(entries: DataFrame) -> DataFrame:
    """One row per file: names unique within a post of several files, tags grouped, rating and date mapped."""
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    words = lambda k: F.coalesce(F.array_join(F.from_json(get(k), META), " "), get(k))
    num = get("num").cast("int")
    name = F.when(F.coalesce(num, F.lit(0)) > 0, F.concat_ws("_", F.concat_ws("_", get("category"), get("id")), num.cast("string"))).otherwise(F.concat_ws("_", get("category"), get("id")))
    cols = {"artist": "tags_artist", "character": "tags_character", "copyright": "tags_copyright", "general": "tags_general", "meta": "tags_metadata"}
    flat = entries.select(
        "url", get("id").cast("long").alias("id"), get("category").alias("category"), name.alias("file_name"), F.lower(get("extension")).alias("extension"),
        rating_of(F.coalesce(get("rating"), F.lit("")), True).alias("rating"), resolve_source(get("source"), F.col("url")).alias("source"), F.coalesce(get("date"), get("created_at")).alias("published_at"),
        *[words(c).alias(c) for c in cols.values()], words("tags").alias("all_tags"), F.coalesce(get("username"), get("user")).alias("user"),
    )
    # sites without typed tags: all are general, and the user stands for the artist
    typed = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols.values()]).isNotNull()
    flat = flat.withColumn("tags_general", F.when(typed, F.col("tags_general")).otherwise(F.col("all_tags")))
    flat = flat.withColumn("tags_artist", F.when(F.coalesce(F.col("tags_artist"), F.lit("")) != "", F.col("tags_artist")).otherwise(F.regexp_replace("user", r"\s+", "_")))
    return grouped_tags(flat, cols).drop("all_tags", "user", *cols.values())


def settled(pages_known: list[tuple[int, int]], streak: int = 3) -> int | None:
    """Number of the page after which paging stops: so many pages in a row with nothing new; (rows, known rows) each."""
    run = 0
    for k, (rows, known) in enumerate(pages_known):
        run = run + 1 if rows and rows == known else 0
        if run >= streak:
            return k
    return None


def layered(layers: list[DataFrame], authority: DataFrame | None = None) -> DataFrame:
    """(name, display) from layers where later ones win; names with spaces get underscores; outside the authority they go."""
    out = None
    for k, df in enumerate(layers):
        one = df.select(F.regexp_replace("name", " ", "_").alias("name"), "display", F.lit(k).alias("layer"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("name").agg(F.max_by("display", "layer").alias("display"))
    return best if authority is None else best.join(authority.select("name"), "name", "left_semi")
