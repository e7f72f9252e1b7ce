"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from galleon.functions.columns import aspect_ratio, extension, full_path, hex_colour, is_image_path, match_probability, pack_rgb, safe_dir, srgb_to_lab, stem
from galleon.functions.palette import palettes
from galleon.functions.shapes import shaped
from galleon.operators import annotations as an, changes as ch, dedup, facets as fa, kept, metric, pending as pe, sampling as sa, search as se, stats as st
from galleon.operators.filters import PostFilter as PF, apply_filter
from galleon.operators.graph import connected_components
from galleon.operators.regroup import NearGroups
from galleon.operators.tree import folder_tree
from galleon.plans.views import Library, as_table, open_library, shared_folder, sql_of
from galleon.sources.keyed import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, plan: Callable[[Library], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(open_library(spark, sf_dir))
    if sql:
        ORACLE[name] = sql_of(sql)


C = "canonical_post_id IS NULL"
POSTS = "SELECT p.id, p.score, p.rating FROM g_posts p"


def ids(f: PF) -> Callable[[Library], DataFrame]:
    return lambda lib: apply_filter(lib, f).select("id", "score", "rating")


# --- filters (P1-P8, J1-J4) ---------------------------------------------------------------------------------------
add("count_canonical", lambda lib: fa.count_posts(lib, PF()), f"SELECT count(id) AS n FROM g_posts WHERE {C}")  # A1, P2
add("count_all", lambda lib: fa.count_posts(lib, PF(only_canonical=False)), "SELECT count(id) AS n FROM g_posts")
add("filter_rating_in", ids(PF(rating=[1, 3])), f"{POSTS} WHERE {C} AND rating IN (1, 3)")  # P3
add("filter_score_in", ids(PF(score=[0, 5])), f"{POSTS} WHERE {C} AND score IN (0, 5)")
add("filter_ext_in", ids(PF(extension=["png"])), f"{POSTS} WHERE {C} AND extension IN ('png')")
add("filter_tags_and", ids(PF(tags=["hot", "Brand#13"])), f"{POSTS} WHERE {C} AND EXISTS (SELECT 1 FROM g_post_has_tag t WHERE t.post_id = p.id AND t.tag_name = 'hot') AND EXISTS (SELECT 1 FROM g_post_has_tag t WHERE t.post_id = p.id AND t.tag_name = 'Brand#13')")  # P4
add("filter_folder_prefix", ids(PF(folder="ECONOMY", only_canonical=False)), f"{POSTS} WHERE file_path = 'ECONOMY' OR (file_path >= 'ECONOMY/' AND file_path < 'ECONOMY0')")  # P5
add("filter_folder_sibling_guard", ids(PF(folder="ECONOMY/Brand#1", only_canonical=False)), f"{POSTS} WHERE file_path = 'ECONOMY/Brand#1' OR starts_with(file_path, 'ECONOMY/Brand#1/')")
add("filter_score_range", ids(PF(waifu_score_range=(2.5, 7.5))), f"{POSTS} LEFT JOIN g_waifu w ON w.post_id = p.id WHERE {C} AND w.score >= 2.5 AND w.score <= 7.5")  # P6
add("filter_levels", ids(PF(waifu_score_levels=["A", "E"])), f"{POSTS} LEFT JOIN g_waifu w ON w.post_id = p.id WHERE {C} AND ((w.score >= 8 AND w.score < 10.001) OR (w.score >= 0 AND w.score < 2))")  # P7
add("filter_levels_unscored", ids(PF(silva_score_levels=["B", "UNSCORED"])), f"{POSTS} LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' WHERE {C} AND ((s.score >= 0.6 AND s.score < 0.8) OR s.post_id IS NULL)")
add("filter_levels_bogus", ids(PF(waifu_score_levels=["nope"])), f"{POSTS} WHERE {C}")
add("filter_both_scorers", ids(PF(silva_score_levels=["A"], silva_luna_score_levels=["A", "B"])), f"{POSTS} LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' LEFT JOIN g_aesthetic l ON l.post_id = p.id AND l.scorer = 'silva_luna' WHERE {C} AND s.score >= 0.8 AND s.score < 1.0001 AND l.score >= 0.6 AND l.score < 1.0001")  # P8, J3
add("filter_kitchen_sink", ids(PF(rating=[0, 1, 2], score=[1, 2, 3, 4, 5], tags=["hot"], extension=["jpg", "png"], waifu_score_range=(1, 9), silva_score_levels=["A", "B", "C", "UNSCORED"])), f"{POSTS} LEFT JOIN g_waifu w ON w.post_id = p.id LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' WHERE {C} AND rating IN (0, 1, 2) AND p.score IN (1, 2, 3, 4, 5) AND p.id IN (SELECT post_id FROM g_post_has_tag WHERE tag_name = 'hot') AND extension IN ('jpg', 'png') AND w.score BETWEEN 1 AND 9 AND ((s.score >= 0.4 AND s.score < 1.0001) OR s.post_id IS NULL)")

# --- facets (A2-A9, A20-A22) --------------------------------------------------------------------------------------
for _c in ("rating", "score", "extension"):
    add(f"facet_{_c}", lambda lib, c=_c: fa.count_by_column(lib, c, PF()), f"SELECT {_c}, count(id) AS n FROM g_posts WHERE {C} GROUP BY {_c}")  # A2


def _bucket_sql(view: str, edges: tuple, scorer: str = "") -> str:
    e, d, c, b = edges
    on = f" AND w.scorer = '{scorer}'" if scorer else ""
    return f"SELECT CASE WHEN w.post_id IS NULL THEN 'UNSCORED' WHEN w.score >= {b} THEN 'A' WHEN w.score >= {c} THEN 'B' WHEN w.score >= {d} THEN 'C' WHEN w.score >= {e} THEN 'D' ELSE 'E' END AS bucket, count(*) AS n FROM g_posts p LEFT JOIN {view} w ON w.post_id = p.id{on} WHERE {C} GROUP BY 1"


add("facet_waifu_bucket", lambda lib: fa.count_by_bucket(lib, "waifu", PF()), _bucket_sql("g_waifu", (2, 4, 6, 8)))  # A3, A4
add("facet_silva_bucket", lambda lib: fa.count_by_bucket(lib, "silva", PF()), _bucket_sql("g_aesthetic", (0.2, 0.4, 0.6, 0.8), "silva"))
add("facet_luna_bucket", lambda lib: fa.count_by_bucket(lib, "silva_luna", PF()), _bucket_sql("g_aesthetic", (0.2, 0.4, 0.6, 0.8), "silva_luna"))
TAGS = f"SELECT t.tag_name AS name, count(*) AS n FROM g_post_has_tag t JOIN g_posts p ON p.id = t.post_id WHERE {C}"
add("facet_tags_fast", lambda lib: fa.tag_facet(lib, PF(), limit=20, kept=lib.tag_counts), f"{TAGS} GROUP BY 1 ORDER BY n DESC, name LIMIT 20")  # A7
add("facet_tags_filtered", lambda lib: fa.tag_facet(lib, PF(rating=[1, 2]), limit=20), f"{TAGS} AND p.rating IN (1, 2) GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
add("facet_tags_like", lambda lib: fa.tag_facet(lib, PF(), query="BRAND#1", extra=["hot"], limit=20, kept=lib.tag_counts), f"SELECT * FROM ({TAGS} GROUP BY 1) WHERE contains(lower(name), 'brand#1') OR name = 'hot' ORDER BY n DESC, name LIMIT 20")
add("facet_without_self", lambda lib: fa.facet_share(fa.count_by_column(lib, "rating", PF(rating=[1], extension=["jpg"]).without("rating"))), f"SELECT rating, n, round(n * 100.0 / sum(n) OVER (), 1) AS pct FROM (SELECT rating, count(id) AS n FROM g_posts WHERE {C} AND extension = 'jpg' GROUP BY rating)")  # A21
add("stats_overall", lambda lib: fa.overall_stats(lib, PF()), f"SELECT count(*) AS total, round(avg(CASE WHEN p.score > 0 THEN p.score END), 6) AS avg_score, count(CASE WHEN p.score > 0 THEN 1 END) AS scored_count, round(avg(w.score), 6) AS avg_waifu, count(w.score) AS waifu_count FROM g_posts p LEFT JOIN g_waifu w ON w.post_id = p.id WHERE {C}")  # A5
add("stats_rating_distribution", lambda lib: fa.rating_distribution(lib, PF()), f"SELECT coalesce(rating, 0) AS rating, count(*) AS n FROM g_posts WHERE {C} GROUP BY 1")
add("hist_waifu", fa.waifu_histogram, "SELECT b.bin AS bin, b.bin || '~' || (b.bin + 1) AS label, count(w.post_id) AS n FROM (SELECT CAST(unnest(range(10)) AS BIGINT) AS bin) b LEFT JOIN g_waifu w ON least(CAST(floor(w.score) AS BIGINT), 9) = b.bin GROUP BY 1, 2")  # A8
SUMS = "count(*) AS posts, coalesce(sum(CASE WHEN p.score > 0 THEN p.score END), 0) AS ss, count(CASE WHEN p.score > 0 THEN 1 END) AS sn, sum(p.rating) AS rs, coalesce(sum(s.score), 0) AS vs, count(s.score) AS vn, coalesce(sum(l.score), 0) AS ls, count(l.score) AS ln"
JOINS = "LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' LEFT JOIN g_aesthetic l ON l.post_id = p.id AND l.scorer = 'silva_luna'"
AVG = "CASE WHEN sn > 0 THEN round(CAST(ss AS DOUBLE) / sn, 6) END AS score_avg, round(CAST(rs AS DOUBLE) / posts, 6) AS rating_avg, CASE WHEN vn > 0 THEN round(vs / vn, 6) END AS silva_avg, CASE WHEN ln > 0 THEN round(ls / ln, 6) END AS luna_avg"
add("folder_direct", fa.folder_direct, f"SELECT file_path, posts, {AVG} FROM (SELECT p.file_path, {SUMS} FROM g_posts p {JOINS} GROUP BY 1)")  # A6, J11
add("folder_rollup", fa.folder_rollup, f"SELECT folder, posts, {AVG} FROM (SELECT f.folder, {SUMS} FROM g_posts p JOIN (SELECT DISTINCT file_path, '.' AS folder FROM g_posts UNION SELECT file_path, split_part(file_path, '/', 1) FROM g_posts UNION SELECT file_path, file_path FROM g_posts) f ON f.file_path = p.file_path {JOINS} GROUP BY 1)")  # A6b
add("selection_stats", lambda lib: fa.selection_stats(lib.posts.where("file_path LIKE 'ECONOMY/%'")), "SELECT count(*) AS n, " + ", ".join([f"count(CASE WHEN rating = {k} THEN 1 END) AS rating_{k}" for k in range(5)] + [f"count(CASE WHEN score = {k} THEN 1 END) AS score_{k}" for k in range(6)]) + ", min(CASE WHEN width > 0 THEN width END) AS min_width, max(CASE WHEN width > 0 THEN width END) AS max_width, min(CASE WHEN height > 0 THEN height END) AS min_height, max(CASE WHEN height > 0 THEN height END) AS max_height, CASE WHEN min(rating) = max(rating) THEN min(rating) END AS common_rating, CASE WHEN min(score) = max(score) THEN min(score) END AS common_score, CASE WHEN min(extension) = max(extension) THEN min(extension) END AS common_extension, CASE WHEN min(file_path) = max(file_path) THEN min(file_path) WHEN min(split_part(file_path, '/', 1)) = max(split_part(file_path, '/', 1)) THEN min(split_part(file_path, '/', 1)) ELSE '' END AS common_folder FROM g_posts WHERE file_path LIKE 'ECONOMY/%'")  # A20
add("extension_tally", lambda lib: fa.extension_tally(lib.posts), "SELECT extension, count(*) AS n FROM g_posts GROUP BY 1")  # A22
ROW = "id, file_path, file_name, extension, width, height, score, rating"

# --- search and pages (O1-O9, W7) ---------------------------------------------------------------------------------
add("search_default_desc", lambda lib: se.search(lib, PF(), "score", limit=50), f"SELECT {ROW} FROM g_posts WHERE {C} ORDER BY score DESC, id DESC LIMIT 50")  # O1
add("search_nulls_asc", lambda lib: se.search(lib, PF(), "published_key", "asc", limit=300, offset=20), f"SELECT {ROW} FROM g_posts WHERE {C} ORDER BY published_key ASC NULLS FIRST, id LIMIT 300 OFFSET 20")
PR = "p.id, file_path, file_name, extension, width, height, p.score, rating"
add("search_waifu_sort", lambda lib: se.search(lib, PF(), "waifu_score", limit=100), f"SELECT {PR}, w.score AS waifu_score FROM g_posts p LEFT JOIN g_waifu w ON w.post_id = p.id WHERE {C} ORDER BY w.score DESC NULLS LAST, p.id DESC LIMIT 100")  # O2
add("search_silva_sort", lambda lib: se.search(lib, PF(), "silva_score", "asc", limit=100), f"SELECT {PR}, s.score AS silva_score FROM g_posts p LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' WHERE {C} ORDER BY s.score ASC NULLS LAST, p.id LIMIT 100")
add("search_discrepancy", lambda lib: se.search(lib, PF(), "discrepancy", limit=50).withColumn("discrepancy", F.round("discrepancy", 6)), f"SELECT {PR}, round(CASE WHEN p.score >= 1 AND s.score IS NOT NULL THEN abs(s.score * 4 + 1 - p.score) END, 6) AS discrepancy FROM g_posts p LEFT JOIN g_aesthetic s ON s.post_id = p.id AND s.scorer = 'silva' WHERE {C} ORDER BY CASE WHEN p.score >= 1 AND s.score IS NOT NULL THEN abs(s.score * 4.0::DOUBLE + 1.0::DOUBLE - p.score) END DESC NULLS LAST, p.id DESC LIMIT 50")  # O3
add("search_random_seeded", lambda lib: se.search(lib, PF(), direction="random", seed=1234567891, limit=50), f"SELECT {ROW} FROM g_posts WHERE {C} ORDER BY (id * 1234567891) % 2147483647 LIMIT 50")  # O4
add("search_random_resort", lambda lib: se.search(lib, PF(), direction="random", seed=77, limit=50, offset=10, resort="score").select(*se.SIMPLE), f"SELECT * FROM (SELECT {ROW} FROM g_posts WHERE {C} ORDER BY (id * 77) % 2147483647 LIMIT 50 OFFSET 10) ORDER BY score DESC, id DESC")  # O5
add("search_lab", lambda lib: se.search(lib, PF(lab=(50, 0, 0)), limit=20).withColumn("distance", F.round("distance", 5)), f"SELECT {ROW}, round(sqrt((lab_l - 50) * (lab_l - 50) + lab_a * lab_a + lab_b * lab_b), 5) AS distance FROM g_posts WHERE {C} AND lab_l IS NOT NULL ORDER BY sqrt((lab_l - 50) * (lab_l - 50) + lab_a * lab_a + lab_b * lab_b), id LIMIT 20")  # O6, V5
add("list_keyset", lambda lib: se.keyset_page(lib, 100, 50), f"SELECT id, row_number() OVER (ORDER BY id) > 50 AS is_next FROM (SELECT id FROM g_posts WHERE id >= 100 AND {C} ORDER BY id LIMIT 51)")  # O8, W7
COUNTS = f"SELECT g.name AS name, g.group_id AS group_id, count(p.id) AS post_count FROM g_tags g LEFT JOIN g_post_has_tag t ON t.tag_name = g.name LEFT JOIN g_posts p ON p.id = t.post_id AND p.{C} GROUP BY 1, 2"
add("tags_keyset", lambda lib: se.tags_page(lib.tag_counts, "Brand#2", 15), f"SELECT name, post_count FROM ({COUNTS}) WHERE name > 'Brand#2' ORDER BY name LIMIT 15")  # O9
add("tag_count_refresh", fa.tag_counts, COUNTS)  # D15

# --- read models (J9, J19, J22, P12, P13) -------------------------------------------------------------------------
add("detail_nested", lambda lib: se.details(lib, lib.posts.where("id <= 50")).select("id", "full_path", F.round("aspect_ratio", 6).alias("aspect_ratio"), "waifu_score", "members", F.array_join(F.transform("tags", lambda t: t["name"]), ",").alias("tags"), F.size("aesthetic").alias("scores")), """
SELECT p.id AS id, file_path || '/' || file_name || '.' || extension AS full_path, round(CASE WHEN height <> 0 THEN CAST(width AS DOUBLE) / height END, 6) AS aspect_ratio, w.score AS waifu_score, (SELECT count(*) FROM g_posts m WHERE m.canonical_post_id = p.id) AS members,
 coalesce((SELECT string_agg(t.tag_name, ',' ORDER BY CASE g.name WHEN 'artist' THEN 0 WHEN 'copyright' THEN 1 WHEN 'character' THEN 2 WHEN 'general' THEN 3 WHEN 'meta' THEN 4 ELSE 5 END, t.tag_name) FROM g_post_has_tag t JOIN g_tags n ON n.name = t.tag_name LEFT JOIN g_tag_groups g ON g.id = n.group_id WHERE t.post_id = p.id), '') AS tags,
 CAST((SELECT count(*) FROM g_aesthetic a WHERE a.post_id = p.id) AS INT) AS scores FROM g_posts p LEFT JOIN g_waifu w ON w.post_id = p.id WHERE p.id <= 50""")
add("shape_detail", lambda lib: shaped(se.details(lib, lib.posts.where("id <= 50"))).select("id", "fullPath", "waifuScore", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", F.coalesce(t["groupName"], F.lit("")), t["name"])), ",").alias("tags")), """
SELECT p.id AS id, file_path || '/' || file_name || '.' || extension AS "fullPath", w.score AS "waifuScore",
 coalesce((SELECT string_agg(coalesce(g.name, '') || ':' || t.tag_name, ',' ORDER BY CASE g.name WHEN 'artist' THEN 0 WHEN 'copyright' THEN 1 WHEN 'character' THEN 2 WHEN 'general' THEN 3 WHEN 'meta' THEN 4 ELSE 5 END, t.tag_name) FROM g_post_has_tag t JOIN g_tags n ON n.name = t.tag_name LEFT JOIN g_tag_groups g ON g.id = n.group_id WHERE t.post_id = p.id), '') AS tags
FROM g_posts p LEFT JOIN g_waifu w ON w.post_id = p.id WHERE p.id <= 50""")  # P13
add("group_members", lambda lib: lib.posts.where("canonical_post_id = 21").select("id"), "SELECT id FROM g_posts WHERE canonical_post_id = 21")
add("member_counts", lambda lib: se.member_counts(lib.posts), "SELECT canonical_post_id AS id, count(*) AS members FROM g_posts WHERE canonical_post_id IS NOT NULL GROUP BY 1")  # A9
add("ordered_lookup", lambda lib: se.in_given_order(lib.posts, [7, 3, 999999999, 5], True).select("id", "pos"), f"SELECT p.id AS id, v.pos AS pos FROM g_posts p JOIN (SELECT * FROM (VALUES (7, 0), (3, 1), (999999999, 2), (5, 3)) t(id, pos)) v ON v.id = p.id WHERE {C}")  # J22
add("full_paths", lambda lib: lib.posts.select("id", full_path().alias("path"), is_image_path(full_path()).alias("image"), stem(F.concat("file_name", F.lit("."), "extension")).alias("stem"), extension(F.concat("file_name", F.lit("."), "extension")).alias("ext"), F.round(aspect_ratio(), 6).alias("aspect")), "SELECT id, file_path || '/' || file_name || '.' || extension AS path, lower(extension) IN ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp') AS image, file_name AS stem, extension AS ext, round(CASE WHEN height <> 0 THEN CAST(width AS DOUBLE) / height END, 6) AS aspect FROM g_posts")  # S3, P16
add("colour_columns", lambda lib: lib.posts.select("id", hex_colour(pack_rgb(F.col("width") % 256, F.col("height") % 256, (F.col("id") % 256).cast("int"))).alias("hex"), safe_dir(F.concat("file_path", F.lit(". "))).alias("dir")), r"SELECT id, '#' || lpad(lower(printf('%x', (width % 256) * 65536 + (height % 256) * 256 + id % 256)), 6, '0') AS hex, CASE WHEN file_path = '.' THEN '_' ELSE replace(file_path, '/', '_') END AS dir FROM g_posts")

add("shape_simple", lambda lib: shaped(lib.posts.select("id", "file_path", "file_name", "score", "canonical_post_id")), 'SELECT id, file_path AS "filePath", file_name AS "fileName", coalesce(score, 0) AS score, canonical_post_id AS "canonicalPostId" FROM g_posts')  # P13
add("folder_tree", lambda lib: folder_tree(lib.posts.withColumn("failed", F.lit(False)), fa.folder_rollup(lib)).select("folder", "name", "parent", "direct", "total", "rating_avg"), "SELECT f.folder AS folder, CASE WHEN f.folder = '.' THEN '' ELSE split_part(f.folder, '/', -1) END AS name, CASE WHEN f.folder = '.' THEN NULL WHEN contains(f.folder, '/') THEN split_part(f.folder, '/', 1) ELSE '.' END AS parent, count(*) FILTER (p.file_path = f.folder) AS direct, count(*) AS total, round(CAST(sum(p.rating) AS DOUBLE) / count(*), 6) AS rating_avg FROM g_posts p JOIN (SELECT DISTINCT file_path, '.' AS folder FROM g_posts UNION SELECT file_path, split_part(file_path, '/', 1) FROM g_posts UNION SELECT file_path, file_path FROM g_posts) f ON f.file_path = p.file_path GROUP BY 1")  # S4
add("fetch_vectors", lambda lib: se.fetch_vectors(lib.vectors, lib.posts.where("canonical_post_id IS NULL").select("id")).select("post_id"), f"SELECT post_id FROM g_vectors WHERE post_id IN (SELECT id FROM g_posts WHERE {C})")  # S12
add("rotate_post", lambda lib: ch.rotate(lib.posts, 5, "new").select("id", "width", "height", "sha256"), "SELECT id, CASE WHEN id = 5 THEN height ELSE width END AS width, CASE WHEN id = 5 THEN width ELSE height END AS height, CASE WHEN id = 5 THEN 'new' ELSE sha256 END AS sha256 FROM g_posts")  # D22

# --- vectors (V1-V9) ----------------------------------------------------------------------------------------------
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEAR = f"SELECT b.post_id AS post_id, 1 - {COS} AS d FROM g_vectors a, g_vectors b WHERE a.post_id = 42 ORDER BY d, b.post_id"
R5 = lambda df: df.withColumn("distance", F.round(F.abs("distance"), 5))
add("knn_seed", lambda lib: R5(se.knn_of(lib.vectors, 42, 10)), f"SELECT post_id, round(abs(d), 5) AS distance FROM ({NEAR} LIMIT 10)")  # V1, O12
add("similar_posts", lambda lib: R5(se.similar_posts(lib, 42, 20)).select("post_id", "distance", F.round("match_prob", 5).alias("match_prob")), f"SELECT n.post_id AS post_id, round(abs(d), 5) AS distance, round(1 - d, 5) AS match_prob FROM (SELECT * FROM ({NEAR} LIMIT 21) WHERE post_id <> 42) n JOIN g_posts p ON p.id = n.post_id WHERE {C}")  # V2
add("text_vector_search", lambda lib: R5(se.text_search(lib, [1.0] * 8 + [0.0] * 56, PF(rating=[0, 1, 2]), 15, 5)).select("post_id", "distance"), f"SELECT n.post_id AS post_id, round(abs(d), 5) AS distance FROM (SELECT b.post_id, 1 - list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), list_concat(list_transform(range(8), lambda x: 1.0::DOUBLE), list_transform(range(56), lambda x: 0.0::DOUBLE))) AS d FROM g_vectors b ORDER BY d, b.post_id LIMIT 1000) n JOIN g_posts p ON p.id = n.post_id WHERE {C} AND rating IN (0, 1, 2) ORDER BY d, n.post_id LIMIT 15 OFFSET 5")  # V3, J14
add("match_prob", lambda lib: se.knn_of(lib.vectors, 42, 10).select("post_id", F.round(match_probability(1 - F.col("distance"), 10.0, -5.0), 5).alias("p")), f"SELECT post_id, round(1 / (1 + exp(-((1 - d) * 10 - 5))), 5) AS p FROM ({NEAR} LIMIT 10)")  # V4
add("unit_vectors", lambda lib: metric.units_of(lib.vectors).select("post_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total")), "SELECT post_id, round(list_sum(CAST(embedding AS DOUBLE[])) / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS total FROM g_vectors WHERE list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0")  # V6
add("vector_export", lambda lib: dedup.export_vectors(lib).select("post_id", F.size("embedding").alias("dim")), "SELECT v.post_id AS post_id, CAST(len(embedding) AS INT) AS dim FROM g_vectors v JOIN g_posts p ON p.id = v.post_id")  # S10, J15
PAIRS = f"SELECT a.post_id AS a, b.post_id AS b FROM g_vectors a JOIN g_vectors b ON a.post_id < b.post_id WHERE {COS} >= 0.45"
def _keep(lib: Library):
    """Rounds of iterative operators are written to the cluster's shared folder."""
    spark = lib.posts.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint()


add("near_pairs", lambda lib: metric.near_pairs(lib.vectors, 0.55, _keep(lib)), PAIRS)  # V9, J16
#: Vectors with copies: every third one is there again under another id, every ninth one twice.
COPIED = "SELECT post_id, embedding FROM g_vectors UNION ALL SELECT post_id + 10000000, embedding FROM g_vectors WHERE post_id % 3 = 0 UNION ALL SELECT post_id + 20000000, embedding FROM g_vectors WHERE post_id % 9 = 0"
CLASSES = f"WITH x AS ({COPIED}), k AS (SELECT min(post_id) AS rep, count(*) AS copies, embedding FROM x GROUP BY embedding)"


def _copied(lib: Library) -> DataFrame:
    again = lambda m, k: lib.vectors.where(F.col("post_id") % m == 0).select((F.col("post_id") + 10_000_000 * k).alias("post_id"), "embedding")
    return lib.vectors.unionByName(again(3, 1)).unionByName(again(9, 2))


add("near_class_pairs", lambda lib: metric.near_classes(_copied(lib), 0.55, as_table)[0], f"{CLASSES} SELECT a.rep AS a, b.rep AS b, a.copies * b.copies AS post_pairs FROM k a JOIN k b ON a.rep < b.rep WHERE {COS} >= 0.45")
add("vector_classes", lambda lib: metric.near_classes(_copied(lib), 0.55, _keep(lib))[1], f"{CLASSES} SELECT rep, copies, CAST(copies * (copies - 1) / 2 AS BIGINT) AS inner_pairs FROM k")


# lexicographically first: three rounds of "no smaller neighbour is canonical" settle these graphs
FIRST = f"WITH e AS ({PAIRS}), s0 AS (SELECT DISTINCT a AS id FROM e WHERE a NOT IN (SELECT b FROM e)), m0 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM s0)), e1 AS (SELECT * FROM e WHERE a NOT IN (SELECT id FROM s0 UNION SELECT id FROM m0) AND b NOT IN (SELECT id FROM s0 UNION SELECT id FROM m0)), s1 AS (SELECT DISTINCT a AS id FROM e1 WHERE a NOT IN (SELECT b FROM e1)), m1 AS (SELECT DISTINCT b AS id FROM e1 WHERE a IN (SELECT id FROM s1)), s2 AS (SELECT id FROM (SELECT a AS id FROM e UNION SELECT b FROM e) WHERE id NOT IN (SELECT id FROM s0 UNION SELECT id FROM m0 UNION SELECT id FROM s1 UNION SELECT id FROM m1)), s AS (SELECT id FROM s0 UNION SELECT id FROM s1 UNION SELECT id FROM s2) SELECT b AS member, min(a) AS canonical FROM e WHERE a IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM s) GROUP BY b"
add("canonical_assign", lambda lib: dedup.grouped_vectors(lib.vectors, 0.55, as_table), FIRST)  # V10
add("regroup_posts", lambda lib: dedup.rebuild_groups(lib, 0.55, as_table).where("canonical_post_id IS NOT NULL").select("id", "canonical_post_id"), FIRST.replace("FROM g_vectors a JOIN g_vectors b", "FROM (SELECT * FROM g_vectors WHERE post_id IN (SELECT id FROM g_posts)) a JOIN (SELECT * FROM g_vectors WHERE post_id IN (SELECT id FROM g_posts)) b").replace("SELECT b AS member, min(a) AS canonical", "SELECT b AS id, min(a) AS canonical_post_id"))  # V11

# --- annotations (U1, O10, A10, W1, A11, A12, D23, X15) -----------------------------------------------------------
LINE = "SELECT 'pairwise' AS kind, id, created_at, post_a AS post_id, post_b AS other_id, dimension, winner AS verdict FROM g_pairwise UNION ALL SELECT 'absolute', id, created_at, post_id, NULL, dimension, CAST(value AS VARCHAR) FROM g_absolute UNION ALL SELECT 'flag', id, created_at, post_id, NULL, NULL, flag FROM g_flags UNION ALL SELECT 'listwise', id, created_at, coalesce(best, m1), NULL, NULL, NULL FROM g_listwise"
NEWEST = "ORDER BY created_at DESC, kind DESC, id DESC LIMIT 50"
CUT = ("2024-06-01 00:00:00", "flag", 5000)
add("timeline_page1", lambda lib: an.timeline_page(lib, 50), f"SELECT * FROM ({LINE}) {NEWEST}")
add("timeline_cursor", lambda lib: an.timeline_page(lib, 50, CUT), f"SELECT * FROM ({LINE}) WHERE (created_at, kind, id) < (TIMESTAMP '{CUT[0]}', '{CUT[1]}', {CUT[2]}) {NEWEST}")
add("pairwise_count", lambda lib: an.pairwise_counts(lib.pairwise, "overall"), "SELECT count(*) FILTER (winner = 'a') AS a, count(*) FILTER (winner = 'b') AS b, count(*) FILTER (winner = 'tie') AS tie, count(*) FILTER (winner = 'skip') AS skip, count(*) FILTER (winner IN ('a', 'b')) AS decisive, count(*) FILTER (winner IN ('a', 'b', 'tie')) AS total FROM g_pairwise WHERE dimension = 'overall'")
add("flag_latest", lambda lib: an.latest(lib.flags, ["post_id"], "flag"), "SELECT post_id, arg_max(flag, id) AS flag, max(id) AS id FROM g_flags GROUP BY 1")
add("absolute_latest_wins", lambda lib: an.latest(lib.absolute, ["post_id", "dimension"], "value"), "SELECT post_id, dimension, arg_max(value, id) AS value, max(id) AS id FROM g_absolute GROUP BY 1, 2")
add("queue_progress", lambda lib: an.queue_progress([("pairwise", lib.pair_queue)]), "SELECT 'pairwise' AS kind, queue_id, count(*) AS total, CAST(sum(done) AS BIGINT) AS done FROM g_pair_queue GROUP BY queue_id")
add("queue_next_pairwise", lambda lib: an.queue_next_pairs(lib, 1, 20), "SELECT position, post_a, post_b, a.file_name AS name_a, b.file_name AS name_b FROM g_pair_queue q JOIN g_posts a ON a.id = q.post_a JOIN g_posts b ON b.id = q.post_b WHERE queue_id = 1 AND done = 0 ORDER BY position, post_a LIMIT 20")  # O13, J12
add("listwise_pairs", lambda lib: an.listwise_pairs(an.ranking(lib.listwise)), "WITH r AS (SELECT id, best, list_filter([m1, m2, m3], lambda m: m <> best) AS rest FROM g_listwise WHERE best IS NOT NULL) SELECT id, best AS winner, unnest(rest) AS loser FROM r UNION ALL SELECT id, rest[1], rest[2] FROM r")
add("listwise_membership", lambda lib: an.history(an.ranking(lib.listwise), 12, "post_ids").select("id"), "SELECT id FROM g_listwise WHERE 12 IN (m1, m2, m3)")
add("pair_history", lambda lib: an.history(lib.pairwise, 12, "post_a", "post_b").select("id", "winner"), "SELECT id, winner FROM g_pairwise WHERE post_a = 12 OR post_b = 12")
ENDS = "SELECT post_a AS post_id, winner = 'a' AS win, winner = 'b' AS loss FROM g_pairwise WHERE dimension = 'overall' AND winner <> 'skip' UNION ALL SELECT post_b, winner = 'b', winner = 'a' FROM g_pairwise WHERE dimension = 'overall' AND winner <> 'skip'"
WL = f"SELECT post_id, count(*) AS degree, count(*) FILTER (win) AS wins, count(*) FILTER (loss) AS losses FROM ({ENDS}) GROUP BY 1"
add("win_loss_degree", lambda lib: an.win_loss(lib.pairwise, "overall"), WL)
add("unbounded_players", lambda lib: an.unbounded(an.win_loss(lib.pairwise, "overall")).where("direction <> 0"), f"SELECT * FROM (SELECT *, CASE WHEN wins + losses >= 2 AND losses = 0 THEN 1 WHEN wins + losses >= 2 AND wins = 0 THEN -1 ELSE 0 END AS direction FROM ({WL})) WHERE direction <> 0")  # G3
OVERALL = lambda lib: lib.pairwise.where("dimension = 'overall'")
PARTS = lambda lib: connected_components(OVERALL(lib).where("winner <> 'skip'").select(F.col("post_a").alias("a"), F.col("post_b").alias("b")), _keep(lib))
EDGES = "e AS (SELECT post_a AS a, post_b AS b FROM g_pairwise WHERE dimension = 'overall' AND winner <> 'skip' UNION SELECT post_b, post_a FROM g_pairwise WHERE dimension = 'overall' AND winner <> 'skip')"
PARTS_SQL = f"WITH RECURSIVE {EDGES}, cc(id, component) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(cc.component) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc AS r ON r.id = e.b WHERE cc.component < r.component GROUP BY e.b)"
add("components", PARTS, f"{PARTS_SQL} SELECT id, component FROM cc")  # G1
add("main_component", lambda lib: an.main_component(PARTS(lib)), f"{PARTS_SQL} SELECT component, count(*) AS n FROM cc GROUP BY 1 ORDER BY n DESC, component LIMIT 1")  # G2
add("queue_next_absolute", lambda lib: an.queue_next_absolute(lib, 1, 20), "SELECT position, p.id AS post_id, file_path, file_name, extension, sha256, width, height FROM g_absolute_queue q JOIN g_posts p ON p.id = q.post_id WHERE queue_id = 1 AND done = 0 ORDER BY position, p.id LIMIT 20")  # O13, J13
add("queue_next_listwise", lambda lib: an.queue_next_lists(lib, 1, 20).select("position", F.array_join("post_ids", ",").alias("members"), F.size("post_ids").alias("n")), "SELECT position, replace(replace(post_ids, '[', ''), ']', '') AS members, CAST(len(string_split(post_ids, ',')) AS INT) AS n FROM g_listwise_queue WHERE queue_id = 1 AND done = 0 ORDER BY position LIMIT 20")
add("queue_progress_all", lambda lib: an.queue_progress([("pairwise", lib.pair_queue), ("absolute", lib.absolute_queue), ("listwise", lib.listwise_queue)]), " UNION ALL ".join(f"SELECT '{k}' AS kind, queue_id, count(*) AS total, CAST(sum(done) AS BIGINT) AS done FROM {v} GROUP BY queue_id" for k, v in (("pairwise", "g_pair_queue"), ("absolute", "g_absolute_queue"), ("listwise", "g_listwise_queue"))))  # A11
add("ranking_pairs", lambda lib: an.listwise_pairs(an.rankings(lib.rankings)), "WITH r AS (SELECT id, list_transform(string_split(replace(replace(ranking, '[', ''), ']', ''), ','), lambda x: CAST(x AS BIGINT)) AS l FROM g_rankings WHERE ranking <> '[]'), i AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM r), j AS (SELECT id, l, i, unnest(range(i + 1, len(l) + 1)) AS j FROM i) SELECT id, l[i] AS winner, l[j] AS loser FROM j")  # 2.8 json, X15
add("valid_rankings", lambda lib: an.rankings(lib.rankings).select("id", an.valid_ranking().alias("ok")).groupBy("ok").agg(F.count("*").alias("n")), "WITH r AS (SELECT id, list_transform(string_split(replace(replace(post_ids, '[', ''), ']', ''), ','), lambda x: CAST(x AS BIGINT)) AS m, CASE WHEN ranking = '[]' THEN [] ELSE list_transform(string_split(replace(replace(ranking, '[', ''), ']', ''), ','), lambda x: CAST(x AS BIGINT)) END AS l FROM g_rankings) SELECT len(l) = 0 OR (list_sort(l) = list_sort(m) AND len(list_distinct(l)) = len(l)) AS ok, count(*) AS n FROM r GROUP BY 1")  # P22
add("valid_verdicts", lambda lib: lib.absolute.select("id", an.valid_absolute().alias("ok")).groupBy("ok").agg(F.count("*").alias("n")), "SELECT scale IN (2, 3, 5) AND value BETWEEN 1 AND scale AS ok, count(*) AS n FROM g_absolute GROUP BY 1")  # P22

# --- samplers (G8-G17) --------------------------------------------------------------------------------------------
KEY = "(id * 99) % 2147483647"
add("sample_stratified", lambda lib: sa.stratified(lib.posts.where("canonical_post_id IS NULL"), 30, 99), f"WITH q AS (SELECT id, score, row_number() OVER (PARTITION BY score ORDER BY {KEY}, id) AS n FROM g_posts WHERE {C} AND score BETWEEN 1 AND 5), s AS (SELECT id, score, 0 AS r FROM q WHERE n <= 6), f AS (SELECT id, score, 1 AS r FROM g_posts WHERE {C} AND id NOT IN (SELECT id FROM s) ORDER BY {KEY}, id LIMIT 30) SELECT id, score FROM (SELECT * FROM s UNION ALL SELECT * FROM f) ORDER BY r, {KEY}, id LIMIT 30")  # G9, W4
add("sample_random_pairs", lambda lib: sa.random_pairs(sa.pairwise_eligible(lib), 10, 99), f"WITH d AS (SELECT id, row_number() OVER (ORDER BY {KEY}, id) - 1 AS n FROM g_posts WHERE {C} AND id NOT IN (SELECT post_a FROM g_pair_queue WHERE done = 0 UNION SELECT post_b FROM g_pair_queue WHERE done = 0) QUALIFY n < 20) SELECT CAST(floor(n / 2) AS BIGINT) AS pair, arg_min(id, n) AS post_a, arg_max(id, n) AS post_b FROM d GROUP BY 1 HAVING count(*) = 2")  # G10, P19
SILVAS = lambda lib: lib.aesthetic.where("scorer = 'silva'").select("post_id", "score")
add("score_window_candidates", lambda lib: sa.window_candidates(SILVAS(lib), SILVAS(lib).select(F.col("post_id").alias("seed_id"), F.col("score").alias("centre")), seed=99), "SELECT seed_id, post_id, score FROM (SELECT s.post_id AS seed_id, c.post_id AS post_id, c.score AS score, row_number() OVER (PARTITION BY s.post_id ORDER BY (c.post_id * 99) % 2147483647, c.post_id) AS n FROM g_aesthetic s JOIN g_aesthetic c ON c.scorer = 'silva' AND c.post_id <> s.post_id AND abs(c.score - s.score) <= 0.05::DOUBLE WHERE s.scorer = 'silva') WHERE n <= 32")  # G13, J17
add("calibration_partners", lambda lib: sa.calibration_partners(an.unbounded(an.win_loss(lib.pairwise, "overall")).select("post_id", "direction"), SILVAS(lib), seed=99).select("post_id", "direction", "partner", F.round("score", 6).alias("score")), f"WITH w AS (SELECT post_id, CASE WHEN wins + losses >= 2 AND losses = 0 THEN 1 WHEN wins + losses >= 2 AND wins = 0 THEN -1 ELSE 0 END AS direction FROM ({WL})) SELECT post_id, direction, partner, round(score, 6) AS score FROM (SELECT w.post_id AS post_id, direction, c.post_id AS partner, c.score AS score, row_number() OVER (PARTITION BY w.post_id ORDER BY (c.post_id * 99) % 2147483647, c.post_id) AS n FROM w JOIN g_aesthetic o ON o.post_id = w.post_id AND o.scorer = 'silva' JOIN g_aesthetic c ON c.scorer = 'silva' AND c.post_id <> w.post_id AND (c.score - o.score) * direction >= 0.15::DOUBLE AND (c.score - o.score) * direction <= 0.25::DOUBLE WHERE direction <> 0) WHERE n <= 1")  # G17
add("revisit_pool", lambda lib: sa.revisit_pool(lib.pairwise.where("dimension = 'overall'"), an.win_loss(lib.pairwise, "overall").select("post_id", "degree")), f"SELECT e.post_id AS post_id, coalesce(w.degree, 0) AS degree FROM (SELECT post_a AS post_id FROM g_pairwise WHERE dimension = 'overall' UNION SELECT post_b FROM g_pairwise WHERE dimension = 'overall') e LEFT JOIN ({WL}) w ON w.post_id = e.post_id WHERE coalesce(w.degree, 0) < 3")  # G14, J18, U2
add("eligible_absolute", lambda lib: sa.eligible(lib, ["overall", "color"]).select("id"), f"SELECT id FROM g_posts WHERE {C} AND id NOT IN (SELECT post_id FROM g_absolute WHERE dimension IN ('overall', 'color'))")  # P18
add("draw_embedded", lambda lib: sa.draw_embedded(lib, lib.posts.where("canonical_post_id IS NULL"), 40, 99).select("id"), f"SELECT id FROM (SELECT id FROM g_posts WHERE {C} ORDER BY {KEY}, id LIMIT 80) WHERE id IN (SELECT post_id FROM g_vectors) ORDER BY {KEY}, id LIMIT 40")  # G8, U4

add("eligible_unqueued", lambda lib: sa.eligible(lib, ["overall"], lib.absolute_queue.where("done = 0").select(F.col("post_id").alias("id"))).select("id"), f"SELECT id FROM g_posts WHERE {C} AND id NOT IN (SELECT post_id FROM g_absolute WHERE dimension = 'overall') AND id NOT IN (SELECT post_id FROM g_absolute_queue WHERE done = 0)")  # P18
add("sample_similar", lambda lib: sa.similar_pairs(lib, 20, 99))  # G11
add("sample_windows", lambda lib: sa.window_members(lib, OVERALL(lib), 12, 6, 99, _keep(lib)))  # G12, G13, G15
add("sample_close", lambda lib: sa.close_pairs_plan(lib, OVERALL(lib), PARTS(lib), 20, 99, _keep(lib)))  # G18, G19
add("sample_groups", lambda lib: sa.listwise_groups(lib, OVERALL(lib), 8, 99, keep=_keep(lib)))  # G20
FREE = f"{C} AND id NOT IN (SELECT post_a FROM g_pair_queue WHERE done = 0 UNION SELECT post_b FROM g_pair_queue WHERE done = 0)"
MAIN = "m AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)"
add("sample_anchors", lambda lib: sa.anchors(lib, OVERALL(lib), PARTS(lib), 5, 99), f"{PARTS_SQL}, {MAIN}, l AS (SELECT post_id FROM ({WL}) WHERE degree < 3 AND post_id IN (SELECT id FROM cc JOIN m USING (component)) ORDER BY degree, post_id LIMIT 200) SELECT l.post_id AS post_id, s.score AS score FROM l JOIN g_aesthetic s ON s.post_id = l.post_id AND s.scorer = 'silva' WHERE l.post_id IN (SELECT id FROM g_posts WHERE {FREE}) ORDER BY (l.post_id * 99) % 2147483647, l.post_id LIMIT 5")  # G16
CALIBRATED = f"""{PARTS_SQL}, {MAIN}, w AS (SELECT post_id, wins + losses AS decided, CASE WHEN losses = 0 THEN 1 ELSE -1 END AS direction FROM ({WL}) WHERE degree < 3 AND wins + losses >= 2 AND (wins = 0 OR losses = 0) AND post_id IN (SELECT id FROM cc JOIN m USING (component)) ORDER BY decided DESC, post_id LIMIT 32),
 p AS (SELECT w.post_id AS post_a, c.post_id AS post_b, o.score AS score, decided FROM w JOIN g_aesthetic o ON o.post_id = w.post_id AND o.scorer = 'silva' JOIN g_aesthetic c ON c.scorer = 'silva' AND (c.score - o.score) * direction BETWEEN 0.15::DOUBLE AND 0.25::DOUBLE WHERE c.post_id IN (SELECT id FROM g_posts WHERE {FREE}) QUALIFY row_number() OVER (PARTITION BY w.post_id ORDER BY (c.post_id * 99) % 2147483647, c.post_id) = 1),
 q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY least(post_a, post_b), greatest(post_a, post_b) ORDER BY decided DESC, post_a) = 1)
SELECT post_a, post_b, score FROM q WHERE NOT EXISTS (SELECT 1 FROM g_pairwise h WHERE h.dimension = 'overall' AND least(h.post_a, h.post_b) = least(q.post_a, q.post_b) AND greatest(h.post_a, h.post_b) = greatest(q.post_a, q.post_b)) ORDER BY decided DESC, post_a LIMIT 8"""
add("sample_calibration", lambda lib: sa.calibration_pairs(lib, OVERALL(lib), PARTS(lib), 8, 99), CALIBRATED)  # G17

# --- pending sets (B1-B5, P15, P17, J5-J8) ------------------------------------------------------------------------
IMG = "lower(extension) IN ('jpg', 'jpeg', 'png', 'webp', 'gif', 'bmp')"
OPEN = "NOT EXISTS (SELECT 1 FROM g_failures f WHERE f.post_id = p.id AND f.worker = '{}')"
add("pending_silva", lambda lib: pe.pending_scorer(lib, "silva"), f"SELECT id FROM g_posts p WHERE id IN (SELECT post_id FROM g_vectors) AND id NOT IN (SELECT post_id FROM g_aesthetic WHERE scorer = 'silva') AND {OPEN.format('silva')}")
add("pending_waifu", pe.pending_waifu, f"SELECT id FROM g_posts p LEFT JOIN g_waifu w ON w.post_id = p.id WHERE {IMG} AND w.post_id IS NULL AND {OPEN.format('waifu')}")
add("pending_tagger", pe.pending_tagger, f"SELECT id FROM g_posts p WHERE {IMG} AND id NOT IN (SELECT post_id FROM g_post_has_tag WHERE is_auto = 1) AND {OPEN.format('tagger')}")
add("pending_embedding", pe.pending_embedding, f"SELECT id FROM g_posts p WHERE {IMG} AND id NOT IN (SELECT post_id FROM g_vectors) AND {OPEN.format('embedding:siglip2')}")
add("pending_basics", pe.pending_basics, f"SELECT id, sha256 <> '' AS has_sha256, lab_l IS NOT NULL AS has_colour FROM g_posts p WHERE {IMG} AND (sha256 = '' OR lab_l IS NULL) AND {OPEN.format('basics')}")
BACKLOG = [("waifu", "id IN (SELECT post_id FROM g_waifu)"), ("tagger", "id IN (SELECT post_id FROM g_post_has_tag WHERE is_auto = 1)"), ("embedding", "id IN (SELECT post_id FROM g_vectors)"), ("basics", "sha256 <> '' AND lab_l IS NOT NULL")]
add("backlog", pe.backlog, " UNION ALL ".join(f"SELECT '{n}' AS pipeline, CAST(count(*) AS BIGINT) AS images, CAST(count(*) FILTER ({d}) AS BIGINT) AS done, CAST(count(*) FILTER (NOT ({d}) AND {OPEN.format('embedding:siglip2' if n == 'embedding' else n)}) AS BIGINT) AS todo, round(count(*) FILTER ({d}) * 100.0 / count(*), 1) AS pct FROM g_posts p WHERE {IMG}" for n, d in BACKLOG))  # A19
add("basics_digest", lambda lib: pe.basics(lib.posts.select("id", F.encode("file_name", "utf-8").alias("content"))), "SELECT id, sha256(file_name) AS sha256, CAST(length(file_name) AS BIGINT) AS bytes FROM g_posts")  # X9 in part, 2.8 sha256
add("palette_entries", lambda lib: pe.palette_entries(lib.posts.select("id", F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("id") % 4).cast("int")), lambda i: (F.col("id") * i % 256).cast("int")).alias("colours"))), "SELECT id, CAST(i - 1 AS INT) AS position, CAST(id * i % 256 AS INT) AS colour FROM (SELECT id, unnest(range(1, CASE WHEN id % 4 = 0 THEN 1 ELSE id % 4 END + 1)) AS i FROM g_posts)")  # 2.8 positional entries
add("fresh_posts", lambda lib: lib.pairwise.select("id", pe.fresh_within("created_at", 30, F.lit("2024-06-30").cast("date")).alias("fresh")).groupBy("fresh").agg(F.count("*").alias("n")), "SELECT date_diff('day', CAST(created_at AS DATE), DATE '2024-06-30') BETWEEN 0 AND 30 AS fresh, count(*) AS n FROM g_pairwise GROUP BY 1")  # 2.8 recency
add("selection_extensions", lambda lib: fa.selection_extensions(lib.posts.where("file_path LIKE 'ECONOMY/%'")), "SELECT lower(extension) AS extension, count(*) AS n, CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS pixels FROM g_posts WHERE file_path LIKE 'ECONOMY/%' GROUP BY 1")  # A20
add("non_images", lambda lib: lib.posts.where(~F.lower("extension").isin("jpg", "jpeg", "png", "webp", "gif", "bmp")).select("id", "extension"), f"SELECT id, extension FROM g_posts WHERE NOT {IMG}")  # P21

# --- changes (D1-D15, T8) -----------------------------------------------------------------------------------------
DISK = "file_path, file_name, extension"
add("sync_diff", lambda lib: _sync(lib), f"SELECT 'new' AS side, file_name FROM (SELECT 'new' || CAST(id AS VARCHAR) AS file_name FROM g_posts WHERE id % 10 = 1) UNION ALL SELECT 'lost', file_name FROM g_posts WHERE id % 10 = 0")  # J21, U3


def _sync(lib: Library) -> DataFrame:
    disk = lib.posts.where("id % 10 <> 0").select("file_path", "file_name", "extension").union(lib.posts.where("id % 10 = 1").select("file_path", F.concat(F.lit("new"), F.col("id").cast("string")), "extension"))
    new, lost, _ = ch.reconcile(disk, lib.posts)
    return new.select(F.lit("new").alias("side"), "file_name").union(lost.select(F.lit("lost").alias("side"), "file_name"))


STATE = ("id", "score", "rating", "canonical_post_id")
add("score_mirror", lambda lib: ch.update_field(lib.posts, 21, "score", 5).select(*STATE), "SELECT id, CAST(CASE WHEN id = 21 OR canonical_post_id = 21 THEN 5 ELSE score END AS INT) AS score, rating, canonical_post_id FROM g_posts")  # D1
add("bulk_rating", lambda lib: ch.bulk_update(lib.posts, [1, 2, 3], "rating", 4).select(*STATE), "SELECT id, score, CAST(CASE WHEN id IN (1, 2, 3) THEN 4 ELSE rating END AS INT) AS rating, canonical_post_id FROM g_posts")  # D2
add("make_canonical", lambda lib: ch.make_canonical(lib.posts, 20).select("id", "canonical_post_id"), "SELECT id, CASE WHEN id = 20 THEN NULL WHEN id = o.c OR canonical_post_id = o.c THEN 20 ELSE canonical_post_id END AS canonical_post_id FROM g_posts, (SELECT canonical_post_id AS c FROM g_posts WHERE id = 20) o")  # D4
DEAD = "(SELECT id FROM g_posts WHERE id % 3 = 0)"
add("delete_cascade", lambda lib: _deleted(lib), "SELECT 'posts' AS t, count(*) AS n, count(canonical_post_id) FILTER (canonical_post_id % 3 <> 0) AS m FROM g_posts WHERE id % 3 <> 0 UNION ALL SELECT 'waifu', count(*), 0 FROM g_waifu WHERE post_id % 3 <> 0 UNION ALL SELECT 'aesthetic', count(*), 0 FROM g_aesthetic WHERE post_id % 3 <> 0 UNION ALL SELECT 'post_has_tag', count(*), 0 FROM g_post_has_tag WHERE post_id % 3 <> 0 UNION ALL SELECT 'vectors', count(*), 0 FROM g_vectors WHERE NOT (post_id % 3 = 0 AND post_id IN (SELECT id FROM g_posts)) UNION ALL SELECT 'failures', count(*), 0 FROM g_failures WHERE NOT (post_id % 3 = 0 AND post_id IN (SELECT id FROM g_posts)) UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*), 0 FROM g_{n} WHERE NOT ({' OR '.join(f'{e} IN {DEAD}' for e in ends)})" for n, ends in (("absolute", ["post_id"]), ("flags", ["post_id"]), ("pairwise", ["post_a", "post_b"]), ("listwise", ["m1", "m2", "m3"]), ("absolute_queue", ["post_id"]), ("pair_queue", ["post_a", "post_b"]))) + f" UNION ALL SELECT 'rankings', count(*), 0 FROM g_rankings r WHERE NOT EXISTS (SELECT 1 FROM (SELECT id, CAST(unnest(string_split(replace(replace(post_ids, '[', ''), ']', ''), ',')) AS BIGINT) AS m FROM g_rankings) x WHERE x.id = r.id AND m IN {DEAD}) UNION ALL SELECT 'listwise_queue', count(*), 0 FROM g_listwise_queue r WHERE NOT EXISTS (SELECT 1 FROM (SELECT queue_id, position, CAST(unnest(string_split(replace(replace(post_ids, '[', ''), ']', ''), ',')) AS BIGINT) AS m FROM g_listwise_queue) x WHERE x.queue_id = r.queue_id AND x.position = r.position AND m IN {DEAD})")  # D5


def _deleted(lib: Library) -> DataFrame:
    out = None
    for name, df in ch.delete_posts(lib, lib.posts.where("id % 3 = 0").select("id")).items():
        row = df.agg(F.count("*").alias("n"), (F.count("canonical_post_id") if name == "posts" else F.lit(0).cast("bigint")).alias("m")).select(F.lit(name).alias("t"), "n", "m")
        out = row if out is None else out.union(row)
    return out


add("folder_ids", lambda lib: ch.ids_in_folder(lib.posts, "PROMO"), "SELECT id FROM g_posts WHERE file_path = 'PROMO' OR starts_with(file_path, 'PROMO/')")  # D6
add("upsert_scores", lambda lib: pe.upsert(lib.waifu, lib.waifu.where("post_id % 5 = 0").select("post_id", (F.col("score") / 2).alias("score"), F.lit(1).alias("seq")).union(lib.waifu.where("post_id % 10 = 0").select("post_id", F.lit(1.0), F.lit(2))), ["post_id"]), "SELECT post_id, CASE WHEN post_id % 10 = 0 THEN 1.0 WHEN post_id % 5 = 0 THEN score / 2 ELSE score END AS score FROM g_waifu")  # D9


def _results(lib: Library) -> DataFrame:
    return lib.posts.where("id % 4 = 0").select(F.col("id").alias("post_id"), F.array(F.lit("hot"), F.lit("new_tag")).alias("tags"), F.when(F.col("id") % 8 == 0, "explicit").otherwise("general").alias("rating"))


add("tagger_persist", lambda lib: pe.tagger_links(lib.post_has_tag, _results(lib))[0].groupBy("tag_name", "is_auto").agg(F.count("*").alias("n")), "SELECT tag_name, is_auto, count(*) AS n FROM (SELECT * FROM g_post_has_tag UNION ALL SELECT id, 'new_tag', 1 FROM g_posts WHERE id % 4 = 0 UNION ALL SELECT id, 'hot', 1 FROM g_posts p WHERE id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM g_post_has_tag t WHERE t.post_id = p.id AND t.tag_name = 'hot')) GROUP BY 1, 2")  # D11
add("tagger_rating", lambda lib: pe.tagger_rating(lib.posts, _results(lib)).select("id", "rating"), "SELECT id, CAST(CASE WHEN id % 4 = 0 AND rating = 0 THEN CASE WHEN id % 8 = 0 THEN 4 ELSE 1 END ELSE rating END AS INT) AS rating FROM g_posts")
add("tagger_rating_forced", lambda lib: pe.tagger_rating(lib.posts, _results(lib), False).select("id", "rating"), "SELECT id, CAST(CASE WHEN id % 8 = 0 THEN 4 WHEN id % 4 = 0 THEN 1 ELSE rating END AS INT) AS rating FROM g_posts")  # D12
add("import_upsert", lambda lib: _imported(lib), "SELECT tag_name, count(*) AS n FROM (SELECT post_id, tag_name FROM g_post_has_tag UNION SELECT id, 'imported' FROM g_posts WHERE id <= 10 UNION SELECT id + 1000000, 'imported' FROM g_posts WHERE id <= 5 UNION SELECT id, 'hot' FROM g_posts WHERE id <= 10 UNION SELECT id + 1000000, 'hot' FROM g_posts WHERE id <= 5) GROUP BY 1")  # D7, U5


def _imported(lib: Library) -> DataFrame:
    tags = F.array(F.struct(F.lit("imported").alias("name"), F.lit(2).alias("group_id")), F.struct(F.lit("hot").alias("name"), F.lit(4).alias("group_id")))
    old = lib.posts.where("id <= 10").select((F.col("id") + 2000000).alias("id"), "file_path", "file_name", "extension", "rating", "published_key", tags.alias("tags"))
    new = lib.posts.where("id <= 5").select((F.col("id") + 1000000).alias("id"), "file_path", F.concat(F.lit("n"), "file_name").alias("file_name"), "extension", "rating", "published_key", tags.alias("tags"))
    return ch.import_posts(lib.posts, lib.tags, lib.post_has_tag, old.union(new))["post_has_tag"].groupBy("tag_name").agg(F.count("*").alias("n"))


add("imported_ids", lambda lib: ch.imported_ids(lib.posts, lib.post_has_tag), "SELECT id FROM g_posts WHERE id IN (SELECT post_id FROM g_post_has_tag WHERE is_auto = 0)")  # D8
add("record_failures", lambda lib: pe.record_failures(lib.failures, lib.posts.where("id % 9 = 0").select(F.col("id").alias("post_id"), F.lit("waifu").alias("worker"), F.lit(-1).cast("bigint").alias("first_event"))), "SELECT post_id, worker, first_event FROM g_failures UNION ALL SELECT id, 'waifu', -1 FROM g_posts p WHERE id % 9 = 0 AND NOT EXISTS (SELECT 1 FROM g_failures f WHERE f.post_id = p.id AND f.worker = 'waifu')")  # D10

# --- statistics (A13-A18) -----------------------------------------------------------------------------------------
XY = "SELECT w.post_id AS id, w.score AS x, s.score AS y FROM g_waifu w JOIN g_aesthetic s ON s.post_id = w.post_id AND s.scorer = 'silva'"
add("describe_scores", lambda lib: st.describe(st.scored_pairs(lib), "x"), f"SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS low, round(max(x), 6) AS high, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p:02d}" for p in st.PERCENTS) + f" FROM ({XY})")
add("score_histogram", lambda lib: st.histogram(st.scored_pairs(lib), "x", 0.0, 10.0, 8), f"SELECT bin, n, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM (SELECT CAST(least(greatest(floor(x / 1.25), 0), 7) AS BIGINT) AS bin, count(*) AS n FROM ({XY}) GROUP BY 1)")
add("corr_pearson", lambda lib: st.pearson(st.scored_pairs(lib)), f"SELECT round(corr(x, y), 6) AS r FROM ({XY})")
add("corr_spearman", lambda lib: st.spearman(st.scored_pairs(lib)), f"SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ({XY}))")  # W3
add("joint_grid", lambda lib: st.joint_grid(st.scored_pairs(lib)), f"WITH v AS ({XY}), q AS (SELECT quantile_cont(x, 0.05) AS xl, quantile_cont(x, 0.95) AS xh, quantile_cont(y, 0.05) AS yl, quantile_cont(y, 0.95) AS yh FROM v) SELECT CAST(least(greatest(floor((x - xl) / ((xh - xl) / 5)), 0), 4) AS BIGINT) AS x_bin, CAST(least(greatest(floor((y - yl) / ((yh - yl) / 5)), 0), 4) AS BIGINT) AS y_bin, count(*) AS n FROM v, q GROUP BY 1, 2")
add("zgap_extremes", lambda lib: st.z_gaps(st.scored_pairs(lib)), f"WITH v AS ({XY}), m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM v), g AS (SELECT id, (x - mx) / sx - (y - my) / sy AS gap FROM v, m) SELECT 'high' AS side, id, round(gap, 6) AS gap FROM (SELECT * FROM g ORDER BY gap DESC, id LIMIT 5) UNION ALL SELECT 'low', id, round(gap, 6) FROM (SELECT * FROM g ORDER BY gap, id LIMIT 5)")


# --- streams (T1-T6): drained at once -----------------------------------------------------------------------------
def _stream_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.streaming.pipelines import run_backfill

    top = shared_folder(spark) + f"/galleon-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    open_library(spark, sf_dir).posts.select("id").write.mode("overwrite").parquet(f"{top}/in")
    run_backfill(spark, f"{top}/in", "id long", f"{top}/out", f"{top}/state", _half)
    return spark.read.parquet(f"{top}/out").select("post_id", "score")


def _half(ids: list[int]) -> list[float]:
    return [i / 2 for i in ids]


QUERIES["stream_backfill"] = _stream_backfill
ORACLE["stream_backfill"] = sql_of("SELECT id AS post_id, CAST(id AS DOUBLE) / 2 AS score FROM g_posts")


def _stream_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galleon.streaming.pipelines import stream_tag_counts

    name = f"tag_counts_{uuid.uuid4().hex}"
    top = shared_folder(spark) + f"/galleon-{spark.sparkContext.applicationId}-{name}"
    open_library(spark, sf_dir).post_has_tag.write.mode("overwrite").parquet(f"{top}/in")
    return stream_tag_counts(spark, f"{top}/in", "post_id long, tag_name string, is_auto int", f"{top}/out", f"{top}/state")


QUERIES["stream_tag_counts"] = _stream_tag_counts
ORACLE["stream_tag_counts"] = sql_of("SELECT tag_name, count(*) AS n FROM g_post_has_tag GROUP BY 1")


# --- stored state: keyed tables, and figures kept beside them (D1-D15, G1-G4) --------------------------------------
def _stored(lib: Library, name: str, keys: list[str], by: list[str] | None = None, buckets: int = 16) -> KeyedTable:
    """A new keyed table in the shared folder; it goes when the session's JVM ends."""
    spark = lib.posts.sparkSession
    path = f"{shared_folder(spark)}/galleon-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return KeyedTable(spark, f"{path}/{name}", keys, by, buckets)


def _keyed_scores(lib: Library) -> DataFrame:
    """Scores are replaced, then some are deleted, then new ones come."""
    table = _stored(lib, "waifu", ["post_id"])
    table.create(lib.waifu)
    table.upsert(lib.waifu.where("post_id % 5 = 0").select("post_id", (F.col("score") / 2).alias("score")))
    table.delete(lib.waifu.where("post_id % 7 = 0"))
    table.upsert(lib.posts.where("id % 35 = 0").select(F.col("id").alias("post_id"), F.lit(1.5).alias("score")))
    return table.read()


add("keyed_scores", _keyed_scores, "SELECT post_id, CASE WHEN post_id % 5 = 0 THEN score / 2 ELSE score END AS score FROM g_waifu WHERE post_id % 7 <> 0 UNION ALL SELECT id, 1.5::DOUBLE FROM g_posts WHERE id % 35 = 0")  # D9 as stored state


def _tag_counts_feed(lib: Library) -> DataFrame:
    """Counts that follow grouping, ungrouping, deletes and links, each refreshed once, with a refresh that has nothing to do."""
    links, posts, counts = _stored(lib, "links", ["post_id", "tag_name"], ["post_id"]), _stored(lib, "posts", ["id"]), _stored(lib, "counts", ["name"])
    pair, own = lib.post_has_tag.select("post_id", "tag_name").distinct(), lib.posts.select("id", "canonical_post_id")
    links.create(pair)
    posts.create(own)
    feed = kept.TagCounts(links, posts, counts)
    feed.refresh()
    posts.upsert(own.where("id % 8 = 3").select("id", (F.col("id") - 1).alias("canonical_post_id")))
    feed.refresh()
    posts.upsert(own.where("id % 20 = 0").select("id", F.lit(None).cast("bigint").alias("canonical_post_id")))
    links.delete(pair.where("post_id % 9 = 1"))
    feed.refresh()
    posts.delete(own.where("id % 11 = 5").select("id"))
    links.upsert(own.where("id % 6 = 2").select(F.col("id").alias("post_id"), F.lit("fresh").alias("tag_name")))
    feed.refresh()
    feed.refresh()
    return counts.read()


add("tag_counts_feed", _tag_counts_feed, "WITH p AS (SELECT id, CASE WHEN id % 20 = 0 THEN NULL WHEN id % 8 = 3 THEN id - 1 ELSE canonical_post_id END AS c FROM g_posts WHERE id % 11 <> 5), l AS (SELECT DISTINCT post_id, tag_name FROM g_post_has_tag WHERE post_id % 9 <> 1 UNION SELECT id, 'fresh' FROM g_posts WHERE id % 6 = 2) SELECT tag_name AS name, count(*) AS post_count FROM l JOIN p ON p.id = l.post_id AND p.c IS NULL GROUP BY 1")  # D15


def _comparison_graph(lib: Library) -> DataFrame:
    """The graph of all verdicts of a dimension, taken in batches by time, one of them twice."""
    graph = kept.ComparisonGraph(_stored(lib, "nodes", ["id"]), _keep(lib))
    for batch, part in enumerate(("id % 10 < 6", "id % 10 = 6", "id % 10 = 6", "id % 10 > 6")):
        graph.add(OVERALL(lib).where(part), batch if batch < 2 else batch - 1)
    return graph.nodes.read()


add("comparison_graph", _comparison_graph, f"{PARTS_SQL}, w AS ({WL}) SELECT cc.id AS id, component, degree, wins, losses FROM cc JOIN w ON w.post_id = cc.id")  # G1-G4


def _regroup_batches(lib: Library) -> DataFrame:
    """Groups after three batches of vectors whose ids come in no order."""
    table = _stored(lib, "near", ["id"])
    groups = NearGroups(table.spark, table.path, 0.55, as_table, buckets=4)
    for part in ("post_id % 3 = 1", "post_id % 3 = 0", "post_id % 3 = 2"):
        groups.add(lib.vectors.where(part))
    return groups.groups()


add("regroup_batches", _regroup_batches, FIRST)  # V10-V12, T5


def _timeline_head(lib: Library) -> DataFrame:
    """The first page after inserts, edits and deletes, some of which use up the reserve."""
    events, head = _stored(lib, "events", ["kind", "id"]), _stored(lib, "head", ["kind", "id"], buckets=1)
    line = an.timeline(lib)
    events.create(line)
    top = kept.TimelineHead(events, head, 50)
    top.refresh()
    late = line.where("kind = 'flag' AND id % 50 = 0").select("kind", (F.col("id") + 90_000_000).alias("id"), (F.col("created_at") + F.expr("INTERVAL 20 DAYS")).alias("created_at"), "post_id", "other_id", "dimension", "verdict")
    events.upsert(late)
    top.refresh()
    events.upsert(line.where("kind = 'pairwise' AND id % 3 = 0").withColumn("verdict", F.lit("edited")))
    events.delete(line.where("created_at >= '2024-01-30' AND id % 4 <> 1"))
    top.refresh()
    events.delete(late.where("id % 100 = 0"))
    top.refresh()
    return top.page()


HEAD = f"SELECT kind, id, created_at, post_id, other_id, dimension, CASE WHEN kind = 'pairwise' AND id % 3 = 0 THEN 'edited' ELSE verdict END AS verdict FROM ({LINE}) WHERE NOT (created_at >= TIMESTAMP '2024-01-30' AND id % 4 <> 1) UNION ALL SELECT kind, id + 90000000, created_at + INTERVAL 20 DAYS, post_id, other_id, dimension, verdict FROM ({LINE}) WHERE kind = 'flag' AND id % 50 = 0 AND id % 100 <> 0"
add("timeline_head", _timeline_head, f"SELECT * FROM ({HEAD}) {NEWEST}")  # T12


# --- palettes (X14): every three components of a vector are a pixel ------------------------------------------------
def _pixels(lib: Library) -> DataFrame:
    channel = lambda k: F.least(F.greatest(F.floor((F.element_at("embedding", k).cast("double") + 1) * 128), F.lit(0)), F.lit(255)).cast("int")
    pixel = lambda j: F.struct(*[channel(3 * j + k + 1).alias(c) for k, c in enumerate("rgb")], F.lit(255).alias("a"))
    return lib.vectors.select(F.col("post_id").alias("picture"), F.inline(F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), pixel)))


def _split_sql(k: int, by_volume: bool) -> str:
    """Round k of the palettes in SQL: box sizes, the box to split and the side, the median, the cut."""
    side = {c: f"({c}2 - {c}1 + 1)" for c in "rgb"}
    longest = f"greatest({', '.join(side.values())})"
    of = lambda f: f"CASE WHEN {side['r']} = {longest} THEN {f('r')} WHEN {side['g']} = {longest} THEN {f('g')} ELSE {f('b')} END"
    ends = ", ".join(f"min({c}) OVER w AS {c}1, max({c}) OVER w AS {c}2" for c in "rgb")
    volume = " * ".join(side.values())
    return f"""s{k} AS (SELECT *, sum(n) OVER w AS m, {ends} FROM c{k - 1} WINDOW w AS (PARTITION BY picture, box)),
 t{k} AS (SELECT *, CASE WHEN {volume} > 1 THEN m {f'* {volume}' if by_volume else ''} ELSE -1 END AS weight, {of(str)} AS x, {of(lambda c: c + '1')} AS lo, {of(lambda c: c + '2')} AS hi FROM s{k}),
 u{k} AS (SELECT *, max(weight) OVER (PARTITION BY picture) AS top, sum(n) OVER (PARTITION BY picture, box ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t{k}),
 v{k} AS (SELECT *, min(CASE WHEN 2 * upto > m THEN x END) OVER (PARTITION BY picture, box) AS mid, min(CASE WHEN weight = top THEN box END) OVER (PARTITION BY picture) AS chosen FROM u{k}),
 c{k} AS (SELECT picture, r, g, b, n, CASE WHEN top > 0 AND box = chosen AND x > CASE WHEN mid - lo <= hi - mid THEN least(hi - 1, floor(mid + (hi - mid) / 2.0)) ELSE greatest(lo, floor(mid - 1 - (mid - lo) / 2.0)) END THEN {k} ELSE box END AS box FROM v{k})"""


_CHANNEL = ", ".join(f"CAST(least(greatest(floor((CAST(embedding[3 * j + {k + 1}] AS DOUBLE) + 1) * 128), 0), 255) AS INT) AS {c}" for k, c in enumerate("rgb"))
_CENTRE = {c: f"CAST(floor(sum(n * (2 * {c} + 1) * 8) / (2 * sum(n))) AS INT)" for c in "rgb"}
PALETTES = f"""WITH p AS (SELECT post_id AS picture, {_CHANNEL} FROM (SELECT post_id, embedding, unnest(range(0, len(embedding) // 3)) AS j FROM g_vectors)),
 c0 AS (SELECT picture, r >> 3 AS r, g >> 3 AS g, b >> 3 AS b, count(*) AS n, 0 AS box FROM p WHERE least(r, g, b) <= 250 GROUP BY 1, 2, 3, 4),
 {", ".join(_split_sql(k, k >= 4) for k in range(1, 5))},
 o AS (SELECT picture, box, {_CENTRE["r"]} * 65536 + {_CENTRE["g"]} * 256 + {_CENTRE["b"]} AS colour, CAST(sum(n) AS BIGINT) AS n FROM c4 GROUP BY 1, 2)
SELECT picture, row_number() OVER (PARTITION BY picture ORDER BY n DESC, colour) - 1 AS position, colour, n FROM o"""
add("palettes", lambda lib: palettes(_pixels(lib), 5, _keep(lib)), PALETTES)  # X14


# --- workers that feed one another (T1, T4) -----------------------------------------------------------------------
def _embedded(ids: list[int]) -> list[float]:
    if any(i % 97 == 0 for i in ids):
        raise ValueError("no picture")
    return [i / 4 for i in ids]


def _aesthetic(ids: list[int]) -> list[float]:
    if any(i % 89 == 0 for i in ids):
        raise ValueError("no score")
    return [float(i % 10) for i in ids]


def _worker_chain(lib: Library) -> DataFrame:
    """Embeddings, then scores of what has one; more posts come after the first drain."""
    from galleon.streaming.workers import Chain, Worker

    names = {"posts": ["id"], "embedding": ["post_id"], "silva": ["post_id"], "failures": ["post_id", "worker"]}
    tables = {n: _stored(lib, n, keys, buckets=4) for n, keys in names.items()}
    images = lib.posts.where(is_image_path(full_path())).select("id")
    scored = images.select(F.col("id").alias("post_id"), F.lit(0.0).alias("score")).limit(0)
    tables["posts"].create(images.where("id % 5 <> 0"))
    tables["embedding"].create(scored)
    tables["silva"].create(scored)
    tables["failures"].create(scored.select("post_id", F.lit("").alias("worker"), F.lit("").alias("error")))
    chain = Chain(tables, [Worker("embedding", ("posts",), lambda posts: posts, _embedded), Worker("silva", ("embedding",), lambda e: e.select(F.col("post_id").alias("id")), _aesthetic)], _keep(lib))
    chain.drain()
    tables["posts"].upsert(images.where("id % 5 = 0"))
    chain.drain()
    out = tables["failures"].read().select("worker", "post_id", F.lit(None).cast("double").alias("score"), "error")
    for n in ("embedding", "silva"):
        out = out.unionByName(tables[n].read().select(F.lit(n).alias("worker"), "post_id", "score", F.lit(None).cast("string").alias("error")))
    return out


add("worker_chain", _worker_chain, f"WITH i AS (SELECT id FROM g_posts WHERE {IMG}) SELECT 'embedding' AS worker, id AS post_id, CASE WHEN id % 97 <> 0 THEN id / 4.0::DOUBLE END AS score, CASE WHEN id % 97 = 0 THEN 'ValueError: no picture' END AS error FROM i UNION ALL SELECT 'silva', id, CASE WHEN id % 89 <> 0 THEN CAST(id % 10 AS DOUBLE) END, CASE WHEN id % 89 = 0 THEN 'ValueError: no score' END FROM i WHERE id % 97 <> 0")  # T1, T4


# --- a stream with state that expires (T11) -----------------------------------------------------------------------
TASK_STATE = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


def _stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are kept at the end of the events, which come in two parts, with a restart between them."""
    from galleon.streaming import tasks

    top = _stored(open_library(spark, sf_dir), "tasks", ["task_id"]).path
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    updates = events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.expr(TASK_STATE).alias("state"), F.col("ts").cast("timestamp").alias("updated_at"))
    cut = F.lit("2024-01-20").cast("timestamp")
    for part in (F.col("updated_at") < cut, F.col("updated_at") >= cut):
        updates.where(part).write.mode("append").parquet(f"{top}/in")
        tasks.retain_tasks(spark, f"{top}/in", f"{top}/out", f"{top}/state")
    return tasks.shown_tasks(spark, f"{top}/out")


QUERIES["stream_tasks"] = _stream_tasks
ORACLE["stream_tasks"] = f"WITH l AS (SELECT user_id AS task_id, {TASK_STATE} AS state, CAST(ts AS TIMESTAMP) AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), w AS (SELECT max(epoch_us(CAST(ts AS TIMESTAMP))) // 1000 AS ms FROM events) SELECT task_id, state, updated_at FROM l, w WHERE epoch_us(updated_at) // 1000 + CASE state WHEN 'done' THEN 3600000 ELSE 86400000 END >= ms"


# --- a library that is watched (S2, T6, T8) -----------------------------------------------------------------------
def _on_disk(files: DataFrame, root: str, there: bool) -> None:
    """Makes or removes the files (file_path, file_name, extension) below the root, on the workers."""

    def step(frames):
        for frame in frames:
            for folder, name, ext in frame.itertuples(index=False):
                os.makedirs(f"{root}/{folder}", exist_ok=True)
                path = f"{root}/{folder}/{name}.{ext}"
                if there:
                    open(path, "w").close()
                else:
                    os.unlink(path)
            yield pd.DataFrame({"n": [len(frame)]})

    files.mapInPandas(step, "n long").agg(F.sum("n")).collect()


def _watch_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts after files came and went twice; at first the posts are another state than the files."""
    from galleon.sources.watched import known_files
    from galleon.streaming import sync

    lib = open_library(spark, sf_dir)
    posts = _stored(lib, "posts", sync.KEY, buckets=8)
    top = urlparse(posts.path).path
    root, state, checkpoint = f"{top}/library", f"{top}/watch", f"{posts.path}/polls"
    rows = lib.posts.select("id", *sync.KEY)
    posts.create(rows.where("id % 5 <> 0"))
    late = rows.where("id % 7 = 3").withColumn("file_name", F.concat(F.lit("late"), "file_name"))
    for come, go in ((rows.where("id % 7 <> 3"), None), (late, rows.where("id % 7 <> 3 AND id % 11 = 0"))):
        _on_disk(come.select(*sync.KEY), root, True)
        if go is not None:
            _on_disk(go.select(*sync.KEY), root, False)
        sync.settle(spark, root, state, checkpoint, 8)
        sync.sync_posts(known_files(spark, root, state, 8), posts, _keep(lib))
    known = F.col("id") <= F.lit(rows.where("id % 5 <> 0").agg(F.max("id")).first()[0])  # ids of new posts have gaps
    return posts.read().select(*sync.KEY, F.when(known, F.col("id")).alias("known_id"))


QUERIES["watch_library"] = _watch_library
ORACLE["watch_library"] = sql_of("SELECT file_path, file_name, extension, CASE WHEN id % 5 <> 0 THEN id END AS known_id FROM g_posts WHERE id % 7 <> 3 AND id % 11 <> 0 UNION ALL SELECT file_path, 'late' || file_name, extension, NULL FROM g_posts WHERE id % 7 = 3")


# --- an import run over a listing (S5, S6, P20, X10) --------------------------------------------------------------
LISTED = """SELECT page_id + 1 AS id, page_id % 19 = 4 AS malformed, '2024-01-01' AS created_at, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '' END AS source,
 CASE page_id % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'General' WHEN 2 THEN 'explicit' WHEN 3 THEN 'questionable' END AS rating, CASE WHEN page_id % 40 BETWEEN 10 AND 17 THEN 'mp4' WHEN page_id % 7 = 0 THEN 'PNG' ELSE 'jpg' END AS file_ext,
 CASE WHEN page_id % 13 <> 0 THEN url WHEN page_id % 2 = 0 THEN '' END AS file_url, split_part(url, '/', 3) AS tag_string_artist, CASE WHEN page_id % 4 = 0 THEN split_part(url, '/', 4) ELSE '' END AS tag_string_character, '' AS tag_string_copyright,
 split_part(url, '/', 4) || ' page ' || split_part(url, '/', 3) AS tag_string_general, CAST(NULL AS {text}) AS tag_string_meta FROM {pages}"""
#: Half of the listing is there, but for one post in 61.
THERE = "id < (SELECT max(page_id) FROM {pages}) * 0.7 AND id % 61 <> 5 AND id % 40 <> 12"


def _import_run(spark: SparkSession, sf_dir: str, **more) -> tuple[DataFrame, DataFrame]:
    from galleon.operators.imports import import_run

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = spark.sql(LISTED.replace("{text}", "STRING"), pages=pages)
    there = spark.sql(f"SELECT id FROM {{listed}} WHERE {THERE}", listed=listed, pages=pages)
    outcome = F.when(F.col("id") % 17 == 3, "failed").when(F.col("id") % 6 == 0, "skipped").otherwise("downloaded")
    return import_run(listed, there, lambda wanted: wanted.select("id", outcome.alias("outcome")), _keep(open_library(spark, sf_dir)), "site/tag", "https://posts.example/", page=4, **more)


def _import_sql(body: str) -> str:
    listed = LISTED.replace("{text}", "VARCHAR").replace("{pages}", "pages")
    return f"""WITH l AS ({listed}), r AS (SELECT *, (row_number() OVER (ORDER BY id DESC) - 1) // 4 AS page, {THERE.replace('{pages}', 'pages')} AS known, coalesce(file_url <> '' AND lower(file_ext) IN ('jpg', 'png'), false) AS taken FROM l),
 w AS (SELECT *, taken AND NOT known AS wanted, CASE WHEN id % 17 = 3 THEN 'failed' WHEN id % 6 = 0 THEN 'skipped' ELSE 'downloaded' END AS outcome FROM r WHERE NOT malformed),
 g AS (SELECT page, bool_or(wanted) AS pending, bool_or(known) AS known FROM w GROUP BY page), i AS (SELECT *, count(*) FILTER (pending) OVER (ORDER BY page) AS island FROM g),
 n AS (SELECT *, count(*) FILTER (known AND NOT pending) OVER (PARTITION BY island ORDER BY page) AS run FROM i), e AS (SELECT min(page) AS stop FROM n WHERE run >= 3), s AS (SELECT w.* FROM w, e WHERE stop IS NULL OR page <= stop) {body}"""


def _imported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _import_run(spark, sf_dir)
    return rows.withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["name"], t["group_id"].cast("string"))), " "))


QUERIES["import_run_rows"] = _imported_rows
ORACLE["import_run_rows"] = _import_sql("""SELECT id, 'site/tag' AS file_path, CAST(id AS VARCHAR) AS file_name, file_ext AS extension, CASE WHEN source <> '' THEN source ELSE 'https://posts.example/' || id END AS source, created_at AS published_at,
 CASE lower(rating) WHEN 'general' THEN 1 WHEN 'questionable' THEN 3 WHEN 'explicit' THEN 4 ELSE 0 END AS rating,
 tag_string_artist || ':1' || CASE WHEN tag_string_character <> '' THEN ' ' || tag_string_character || ':2 page:4' ELSE ' ' || split_part(tag_string_general, ' ', 1) || ':4 page:4' END AS tags FROM s WHERE wanted AND outcome <> 'failed'""")
_FIGURES = "count(*) AS total, count(*) FILTER (file_url <> '') AS with_url, count(*) FILTER (taken) AS filtered, count(*) FILTER (wanted AND outcome = 'downloaded') AS downloaded, count(*) FILTER (taken AND NOT wanted OR wanted AND outcome = 'skipped') AS skipped, count(*) FILTER (wanted AND outcome = 'failed') AS failed"
QUERIES["import_run_stats"] = lambda spark, sf_dir: _import_run(spark, sf_dir)[1]
ORACLE["import_run_stats"] = _import_sql(f"SELECT {_FIGURES}, (SELECT stop IS NOT NULL FROM e) AS early_stopped FROM s")
QUERIES["import_full_scan"] = lambda spark, sf_dir: _import_run(spark, sf_dir, full_scan=True)[1]
ORACLE["import_full_scan"] = _import_sql(f"SELECT {_FIGURES}, false AS early_stopped FROM w")
