"""Gallery-shaped tables over the driver's tables: one SQL text each, read by Spark and by DuckDB alike.

A gallery keeps its posts, scores, links and tag counts as tables of its own. So does Library: the first query of a
session that asks for a table writes it, and later ones scan what they need of it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a table of the folder, or for another view.
VIEWS = {
    "g_posts": """
SELECT p_partkey + 1 AS id,
       CASE WHEN p_partkey % 97 = 0 THEN '.' ELSE p_type || '/' || p_brand END AS file_path,
       'f' || CAST(p_partkey AS STRING) AS file_name,
       CASE p_partkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' WHEN 3 THEN 'PNG' WHEN 4 THEN 'zip' ELSE 'jpg' END AS extension,
       CAST(p_size * 40 AS INT) AS width,
       CAST(CASE WHEN p_partkey % 53 = 0 THEN 0 ELSE 600 + p_partkey % 900 END AS INT) AS height,
       CAST(p_size % 6 AS INT) AS score,
       CAST(CAST(floor(p_partkey / 7) AS BIGINT) % 5 AS INT) AS rating,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS published_key,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey * 17) % 101 AS DOUBLE) END AS lab_l,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey * 31) % 257 - 128 AS DOUBLE) END AS lab_a,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST((p_partkey * 43) % 257 - 128 AS DOUBLE) END AS lab_b,
       CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS sha256,
       CASE WHEN p_partkey % 20 = 19 THEN p_partkey - 18 END AS canonical_post_id
FROM {part}""",
    "g_waifu": """
SELECT p_partkey + 1 AS post_id, CAST((p_partkey * 37) % 1001 AS DOUBLE) / 1e2 AS score FROM {part} WHERE p_partkey % 4 <> 0""",
    "g_aesthetic": """
SELECT p_partkey + 1 AS post_id, 'silva' AS scorer, CAST((p_partkey * 53) % 1001 AS DOUBLE) / 1e3 AS score FROM {part} WHERE p_partkey % 3 <> 0
UNION ALL
SELECT p_partkey + 1, 'silva_luna', CAST((p_partkey * 71) % 1001 AS DOUBLE) / 1e3 FROM {part} WHERE p_partkey % 5 <> 0""",
    "g_post_has_tag": """
SELECT p_partkey + 1 AS post_id, split_part(p_name, ' ', 1) AS tag_name, 0 AS is_auto FROM {part}
UNION ALL
SELECT p_partkey + 1, split_part(p_name, ' ', 2), 1 FROM {part} WHERE p_partkey % 3 <> 0
UNION ALL
SELECT p_partkey + 1, p_brand, 0 FROM {part} WHERE p_partkey % 6 = 0""",
    "g_tags": """
SELECT tag_name AS name, CASE WHEN tag_name LIKE 'Brand#%' THEN 1 WHEN max(is_auto) = 1 THEN 4 END AS group_id FROM {g_post_has_tag} GROUP BY tag_name""",
    "g_tag_groups": """
SELECT 1 AS id, 'artist' AS name UNION ALL SELECT 2, 'character' UNION ALL SELECT 3, 'copyright' UNION ALL SELECT 4, 'general' UNION ALL SELECT 5, 'meta'""",
    "g_tag_counts": """
SELECT g.name AS name, g.group_id AS group_id, count(p.id) AS post_count FROM {g_tags} g LEFT JOIN {g_post_has_tag} t ON t.tag_name = g.name LEFT JOIN {g_posts} p ON p.id = t.post_id AND p.canonical_post_id IS NULL GROUP BY 1, 2""",
    "g_vectors": """
SELECT vec_id + 1 AS post_id, embedding FROM {embeddings}""",
    "g_pairwise": """
SELECT event_id + 1 AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, user_id + 1 AS post_a, (user_id + 1) * (1 + event_id % 5) + 1 + event_id % 3 AS post_b,
       CASE event_id % 3 WHEN 0 THEN 'overall' WHEN 1 THEN 'color' ELSE 'finish' END AS dimension,
       CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' ELSE 'skip' END AS winner
FROM {events} WHERE event_type = 'purchase'""",
    "g_absolute": """
SELECT event_id + 1 AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, user_id + 1 AS post_id,
       CASE event_id % 3 WHEN 0 THEN 'overall' WHEN 1 THEN 'color' ELSE 'finish' END AS dimension, CASE event_id % 23 WHEN 7 THEN 4 WHEN 9 THEN 3 ELSE 5 END AS scale, CAST(1 + event_id % 5 AS INT) AS value
FROM {events} WHERE event_type = 'view'""",
    "g_flags": """
SELECT event_id + 1 AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, user_id + 1 AS post_id,
       CASE event_id % 3 WHEN 0 THEN 'love' WHEN 1 THEN 'hate' ELSE 'none' END AS flag
FROM {events} WHERE event_type = 'click'""",
    "g_listwise": """
SELECT event_id + 1 AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, user_id + 1 AS m1, user_id + 2 AS m2, user_id + 3 AS m3,
       CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN user_id + 1 WHEN 2 THEN user_id + 2 ELSE user_id + 3 END AS best
FROM {events} WHERE event_type = 'signup'""",
    "g_failures": """
SELECT user_id + 1 AS post_id, CASE event_id % 4 WHEN 0 THEN 'basics' WHEN 1 THEN 'tagger' WHEN 2 THEN 'waifu' ELSE 'embedding:siglip2' END AS worker,
       min(event_id) AS first_event
FROM {events} WHERE event_type = 'error' GROUP BY 1, 2""",
    "g_pair_queue": """
SELECT o_orderkey % 4 + 1 AS queue_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS position, o_custkey + 1 AS post_a, o_custkey + 2 AS post_b,
       CASE WHEN o_orderstatus = 'F' OR o_orderkey % 31 <> 0 THEN 1 ELSE 0 END AS done
FROM {orders}""",
    "g_absolute_queue": """
SELECT o_orderkey % 3 + 1 AS queue_id, CAST(floor(o_orderkey / 3) AS BIGINT) AS position, o_custkey + 1 AS post_id, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS done
FROM {orders}""",
    "g_listwise_queue": """
SELECT o_orderkey % 2 + 1 AS queue_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS position,
       '[' || CAST(o_custkey + 1 AS STRING) || ',' || CAST(o_custkey + 2 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ',' || CAST(o_custkey + 9 AS STRING) ELSE '' END || ']' AS post_ids,
       CASE WHEN o_orderstatus = 'F' OR o_orderkey % 5 <> 1 THEN 1 ELSE 0 END AS done
FROM {orders}""",
    "g_rankings": """
SELECT event_id + 1 AS id, '[' || CAST(user_id + 1 AS STRING) || ',' || CAST(user_id + 2 AS STRING) || ',' || CAST(user_id + 5 AS STRING) || ',' || CAST(user_id + 7 AS STRING) || ']' AS post_ids,
       CASE WHEN event_id % 17 = 3 THEN '[' || CAST(user_id + 1 AS STRING) || ',' || CAST(user_id + 1 AS STRING) || ']' WHEN event_id % 17 = 5 THEN '[' || CAST(user_id + 1 AS STRING) || ',' || CAST(user_id + 3 AS STRING) || ']' WHEN event_id % 3 = 0 THEN '[]' WHEN event_id % 3 = 1 THEN '[' || CAST(user_id + 5 AS STRING) || ',' || CAST(user_id + 1 AS STRING) || ',' || CAST(user_id + 7 AS STRING) || ',' || CAST(user_id + 2 AS STRING) || ']'
       ELSE '[' || CAST(user_id + 1 AS STRING) || ',' || CAST(user_id + 2 AS STRING) || ',' || CAST(user_id + 5 AS STRING) || ',' || CAST(user_id + 7 AS STRING) || ']' END AS ranking
FROM {events} WHERE event_type = 'signup'""",
}
TABLES = ("part", "embeddings", "events", "orders")


#: Bytes of a kept table up to which it is read as one partition: grouping and joining it then needs no shuffle.
SMALL = 8 << 20
#: Kept tables of this process: (application, folder, table) -> path.
_kept: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session may do without one: its executors are this machine."""
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/galleon"


#: Spark removes a query's shuffle files when the query ends, where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def as_table(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder as Parquet and read again; what it shuffled leaves the disks at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/galleon-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Library:
    """The frames of a gallery: posts, waifu, aesthetic, post_has_tag, tags, tag_counts, tag_groups, vectors, pairwise,
    absolute, flags, listwise, rankings, failures, pair_queue, absolute_queue, listwise_queue. Each is made when it is
    first asked for, so a query opens what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._folder, self._made = spark, sf_dir, {}

    def _frame(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._kept(name) if name in VIEWS else self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._made[name]

    def _kept(self, name: str) -> DataFrame:
        key = (self._spark.sparkContext.applicationId, self._folder, name)
        jvm = self._spark.sparkContext._jvm
        path = _kept.get(key) or f"{shared_folder(self._spark)}/gallery-{uuid.uuid4().hex}/{name}"
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if key not in _kept:
            parts = {t: self._frame(t) for t in (*TABLES, *VIEWS) if "{" + t + "}" in VIEWS[name]}
            fs.deleteOnExit(where.getParent())
            self._spark.sql(VIEWS[name], **parts).write.parquet(path)
            _kept[key] = path
        table = self._spark.read.parquet(path)
        return table.coalesce(1) if fs.getContentSummary(where).getLength() <= SMALL else table

    def __getattr__(self, name: str) -> DataFrame:
        if f"g_{name}" not in VIEWS:
            raise AttributeError(name)
        return self._frame(f"g_{name}")


def open_library(spark: SparkSession, sf_dir: str) -> Library:
    """The gallery over the folder's tables."""
    return Library(spark, sf_dir)


def sql_of(query: str) -> str:
    """DuckDB SQL: the query with the views it names, and those they name, put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in need and any(f"{name}{c}" in text + " " for c in " ,)};.\n"):
                add(VIEWS[name])
                if name not in need:
                    need.append(name)

    add(query)
    names = {n: n for n in (*VIEWS, *TABLES)}
    parts = ", ".join(f"{n} AS ({VIEWS[n].format(**names).strip()})" for n in need)
    body = query.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
