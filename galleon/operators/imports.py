"""An import run as one operation: pages of a listing, where paging ends, what is fetched, the rows, the figures.

A site gives its posts in pages of descending ids and is asked for no more once several pages in a row are settled. Here
the listing is a frame: posts are numbered from cell to cell of a range of ids, pages are what their numbers divide
into, and the end of paging is found by counting, so no window or task spans more than a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from galleon.sources import imports as im

#: Rows of a page, settled pages in a row after which paging ends.
PAGE, STREAK = 200, 3
Keep = Callable[[DataFrame], DataFrame]


def numbered(df: DataFrame, column: str, name: str, cells: int = 256) -> DataFrame:
    """Rows with their place (from 0) by a numeric column that tells them apart, in descending order.

    Values are dealt into cells at approximate quantiles; a place is what the cells above hold and the place in the own
    cell. What is broadcast is a row of splits and the cells' totals.
    """
    splits = df.agg(F.percentile_approx(column, [k / cells for k in range(1, cells)], 10 * cells).alias("_splits"))
    placed = df.join(F.broadcast(splits)).withColumn("_cell", F.size(F.filter("_splits", lambda s: s < F.col(column)))).drop("_splits")
    totals = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    above = totals.select("_cell", (F.sum("_n").over(Window.orderBy(F.desc("_cell"))) - F.col("_n")).alias("_above"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(F.desc(column))) - 1
    return placed.join(F.broadcast(above), "_cell").withColumn(name, F.col("_above") + place).drop("_cell", "_above")


def last_page(pages: DataFrame, streak: int = STREAK, cells: int = 256) -> DataFrame:
    """One row, stop: the page (long, from 0) after which paging ends, or null.

    pages: page, pending, known (long: posts still wanted, posts that are there). A page with posts still wanted breaks
    a streak, one without, but with known ones, makes it longer, any other one does neither: so it is over pages of the
    first two kinds, numbered anew, that a streak is so many consecutive numbers.
    """
    told = numbered(pages.where("pending > 0 OR known > 0").select(F.col("page"), (-F.col("page")).alias("_order"), (F.col("pending") == 0).alias("settled")), "_order", "seq", cells)
    each = told.where("settled").select("page", "seq", F.explode(F.sequence("seq", F.col("seq") + streak - 1)).alias("end"))
    full = each.groupBy("end").agg(F.count("*").alias("n"), F.max(F.struct("seq", "page")).alias("last")).where(f"n = {streak} AND last.seq = end")
    return full.agg(F.min("last.page").alias("stop"))


def import_run(
    listing: DataFrame, imported: DataFrame, fetch: Callable[[DataFrame], DataFrame], keep: Keep, folder: str, site: str,
    limit: int | None = None, full_scan: bool = False, page: int = PAGE, streak: int = STREAK,
) -> tuple[DataFrame, DataFrame]:
    """(rows for `import_posts`, one row of figures).

    listing: the columns of `im.LISTING`, ids once each; rows with malformed = true, if there is such a column, take
    their place in a page and nothing else. imported: ids that are there with tags. fetch: from the posts still wanted to
    (id, outcome), one of downloaded, skipped (the file was there) and failed; a post whose file isn't there gives no row.
    A full scan goes through all pages. site: where a post without a source comes from, followed by its id.
    """
    rows = listing if "malformed" in listing.columns else listing.withColumn("malformed", F.lit(False))
    there = imported.select(F.col("id"), F.lit(True).alias("_there")).dropDuplicates(["id"])
    rows = numbered(rows, "id", "place")
    rows = rows if limit is None else rows.where(F.col("place") < limit)
    takes = F.coalesce((F.col("file_url") != "") & F.lower("file_ext").isin(*im.TAKEN), F.lit(False))
    rows = rows.join(there, "id", "left").withColumn("page", F.floor(F.col("place") / page))
    rows = rows.select(*[c for c in rows.columns if c not in ("_there", "place")], F.coalesce("_there", F.lit(False)).alias("known"), takes.alias("taken"))
    rows = keep(rows.withColumn("wanted", F.col("taken") & ~F.col("known") & ~F.col("malformed")))
    pages = rows.where("NOT malformed").groupBy("page").agg(F.count_if("wanted").alias("pending"), F.count_if("known").alias("known"))
    stop = None if full_scan else last_page(keep(pages), streak).first()[0]
    seen = rows.where("NOT malformed") if stop is None else rows.where((F.col("page") <= stop) & ~F.col("malformed"))
    outcome = fetch(seen.where("wanted").drop("known", "taken", "wanted", "malformed", "page")).select("id", "outcome")
    seen = keep(seen.join(outcome, "id", "left"))
    is_ = lambda o: F.coalesce(F.col("outcome") == o, F.lit(False))
    stats = seen.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce("file_url", F.lit("")) != "").alias("with_url"), F.count_if("taken").alias("filtered"), F.count_if(is_("downloaded")).alias("downloaded"),
        F.count_if((F.col("taken") & ~F.col("wanted")) | is_("skipped")).alias("skipped"), F.count_if(F.col("wanted") & ~is_("downloaded") & ~is_("skipped")).alias("failed"), F.lit(stop is not None).alias("early_stopped"),
    )
    landed = im.listing_tags(seen.where(F.col("wanted") & (is_("downloaded") | is_("skipped"))))
    number = F.col("id").cast("string")
    return landed.select(
        "id", F.lit(folder).alias("file_path"), number.alias("file_name"), F.col("file_ext").alias("extension"),
        im.resolve_source(F.col("source"), F.concat(F.lit(site), number)).alias("source"), F.col("created_at").alias("published_at"), im.rating_of(F.coalesce("rating", F.lit("")), False).alias("rating"), "tags",
    ), stats
