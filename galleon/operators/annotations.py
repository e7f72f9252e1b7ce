"""Annotation events: the merged timeline and its cursor, verdict counts, latest values, queues, comparison graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TIMELINE = ("kind", "id", "created_at", "post_id", "other_id", "dimension", "verdict")


def timeline(lib) -> DataFrame:
    """All events of the four streams in one shape; a list event shows its winner, or else its first member."""
    null = lambda kind: F.lit(None).cast(kind)
    pair = lib.pairwise.select(F.lit("pairwise").alias("kind"), "id", "created_at", F.col("post_a").alias("post_id"), F.col("post_b").alias("other_id"), "dimension", F.col("winner").alias("verdict"))
    absolute = lib.absolute.select(F.lit("absolute").alias("kind"), "id", "created_at", "post_id", null("bigint").alias("other_id"), "dimension", F.col("value").cast("string").alias("verdict"))
    flag = lib.flags.select(F.lit("flag").alias("kind"), "id", "created_at", "post_id", null("bigint").alias("other_id"), null("string").alias("dimension"), F.col("flag").alias("verdict"))
    lists = lib.listwise.select(F.lit("listwise").alias("kind"), "id", "created_at", F.coalesce("best", "m1").alias("post_id"), null("bigint").alias("other_id"), null("string").alias("dimension"), null("string").alias("verdict"))
    return pair.unionByName(absolute).unionByName(flag).unionByName(lists)


def timeline_page(lib, limit: int, cursor: tuple[str, str, int] | None = None) -> DataFrame:
    """Newest first, before the cursor (created_at, kind, id)."""
    events = timeline(lib)
    if cursor:
        at, kind, number = cursor
        events = events.where(F.struct("created_at", "kind", "id") < F.struct(F.lit(at).cast("timestamp"), F.lit(kind), F.lit(number).cast("bigint")))
    return events.orderBy(F.desc("created_at"), F.desc("kind"), F.desc("id")).limit(limit).select(*TIMELINE)


def make_cursor(at: str, kind: str, number: int) -> str:
    return f"{at}|{kind}|{number}"


def parse_cursor(text: str) -> tuple[str, str, int]:
    parts = text.split("|")
    if len(parts) != 3 or not all(parts) or not parts[2].isdigit():
        raise ValueError(f"not a cursor: {text!r}")
    return parts[0], parts[1], int(parts[2])


def pairwise_counts(pairwise: DataFrame, dimension: str) -> DataFrame:
    n = lambda *v: F.count_if(F.col("winner").isin(*v))
    return pairwise.where(F.col("dimension") == dimension).agg(n("a").alias("a"), n("b").alias("b"), n("tie").alias("tie"), n("skip").alias("skip"), n("a", "b").alias("decisive"), n("a", "b", "tie").alias("total"))


def latest(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the newest event (greatest id) of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, "id").alias(value), F.max("id").alias("id"))


def queue_progress(queues: list[tuple[str, DataFrame]]) -> DataFrame:
    parts = [df.groupBy("queue_id").agg(F.count("*").alias("total"), F.sum(F.col("done").cast("int")).cast("bigint").alias("done")).withColumn("kind", F.lit(kind)) for kind, df in queues]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "queue_id", "total", "done").orderBy(F.desc("queue_id"))


def queue_next_pairs(lib, queue_id: int, limit: int) -> DataFrame:
    """Open pairs by position; a pair with a missing post drops out."""
    a, b = (lib.posts.select(F.col("id").alias(f"post_{x}"), F.col("file_name").alias(f"name_{x}")) for x in "ab")
    items = lib.pair_queue.where((F.col("queue_id") == queue_id) & (F.col("done") == 0))
    return items.join(a, "post_a").join(b, "post_b").orderBy("position", "post_a").limit(limit).select("position", "post_a", "post_b", "name_a", "name_b")


def queue_next_absolute(lib, queue_id: int, limit: int) -> DataFrame:
    """Open items by position with what is shown of their posts; an item whose post is missing drops out."""
    posts = lib.posts.select(F.col("id").alias("post_id"), "file_path", "file_name", "extension", "sha256", "width", "height")
    items = lib.absolute_queue.where((F.col("queue_id") == queue_id) & (F.col("done") == 0)).select("position", "post_id")
    return items.join(posts, "post_id").orderBy("position", "post_id").limit(limit).select("position", *posts.columns)


def members_of(column: str) -> Column:
    """A JSON list of post ids as an array; what is no such list is null."""
    return F.from_json(column, "array<bigint>")


def queue_next_lists(lib, queue_id: int, limit: int) -> DataFrame:
    """Open groups by position with their members, in the order of presentation."""
    items = lib.listwise_queue.where((F.col("queue_id") == queue_id) & (F.col("done") == 0))
    return items.orderBy("position").limit(limit).select("position", members_of("post_ids").alias("post_ids"))


def rankings(events: DataFrame) -> DataFrame:
    """Events with members and ranking from their JSON texts, of any number of members; no ranking: skipped."""
    return events.withColumns({"post_ids": members_of("post_ids"), "ranking": F.coalesce(members_of("ranking"), F.array().cast("array<bigint>"))})


def ranking(listwise: DataFrame) -> DataFrame:
    """Events with their members and ranking as arrays: the best first, the rest as presented; none: skipped."""
    members = F.array("m1", "m2", "m3")
    order = F.when(F.col("best").isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(F.array("best"), F.filter(members, lambda m: m != F.col("best"))))
    return listwise.select("id", "created_at", members.alias("post_ids"), order.alias("ranking"))


def listwise_pairs(ranked: DataFrame) -> DataFrame:
    """Every ordered pair (better, worse) that a ranking implies; a ranking's length is bounded by its event."""
    first = ranked.select("id", "ranking", F.posexplode("ranking").alias("i", "winner"))
    return first.select("id", "winner", F.explode(F.expr("slice(ranking, i + 2, size(ranking))")).alias("loser"))


def history(events: DataFrame, post_id: int, *columns: str) -> DataFrame:
    """Events of one post, on whichever side it is; array columns are searched for exact members."""
    kinds = dict(events.dtypes)
    hit = None
    for c in columns:
        this = F.array_contains(c, F.lit(post_id).cast("bigint")) if kinds[c].startswith("array") else F.col(c) == post_id
        hit = this if hit is None else hit | this
    return events.where(hit).orderBy("id")


def win_loss(pairwise: DataFrame, dimension: str | None) -> DataFrame:
    """Degree, wins and losses of each post, in one dimension or all: ties count for the degree, skips for nothing."""
    judged = pairwise.where(F.col("winner") != "skip")
    judged = judged if dimension is None else judged.where(F.col("dimension") == dimension)
    ends = judged.select(F.explode(F.array(*[F.struct(F.col(f"post_{x}").alias("post_id"), (F.col("winner") == x).cast("int").alias("win"), (F.col("winner") == y).cast("int").alias("loss")) for x, y in ("ab", "ba")])).alias("e")).select("e.*")
    return ends.groupBy("post_id").agg(F.count("*").alias("degree"), F.sum("win").alias("wins"), F.sum("loss").alias("losses"))


def unbounded(nodes: DataFrame) -> DataFrame:
    """+1: never lost, -1: never won, with two decisive comparisons at least."""
    many = F.col("wins") + F.col("losses") >= 2
    return nodes.withColumn("direction", F.when(many & (F.col("losses") == 0), 1).when(many & (F.col("wins") == 0), -1).otherwise(0))


def main_component(components: DataFrame) -> DataFrame:
    """The component with the most nodes; of equal ones the smallest name."""
    return components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)


def valid_absolute() -> Column:
    return F.col("scale").isin(2, 3, 5) & F.col("value").between(1, F.col("scale"))


def valid_ranking() -> Column:
    """A permutation of the members, or empty."""
    return (F.size("ranking") == 0) | (F.array_sort("ranking") == F.array_sort("post_ids")) & (F.size(F.array_distinct("ranking")) == F.size("ranking"))


# --- changes: each gives the new state of the events -------------------------------------------------------------


def append(events: DataFrame, new: DataFrame) -> DataFrame:
    return events.unionByName(new, allowMissingColumns=True)


def undo(events: DataFrame, ids: DataFrame, session: str) -> DataFrame:
    """Without the given events, as far as they are of the session."""
    mine = ids.withColumn("session_id", F.lit(session))
    return events.join(mine, ["id", "session_id"], "left_anti").select(*events.columns)


def edit(events: DataFrame, event_id: int, column: str, value, at: Column) -> DataFrame:
    hit = F.col("id") == event_id
    return events.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column))).withColumn("edited_at", F.when(hit, at).otherwise(F.col("edited_at")) if "edited_at" in events.columns else F.when(hit, at))


def create_queue(spark, queue_id: int, items: list, schema: str) -> DataFrame:
    rows = [(queue_id, p, *(i if isinstance(i, tuple) else (i,)), 0) for p, i in enumerate(items)]
    return spark.createDataFrame(rows, f"queue_id long, position long, {schema}, done int")


def mark_done(queue: DataFrame, queue_id: int, positions: list[int]) -> DataFrame:
    """positions: what one request marks, some tens."""
    return queue.withColumn("done", F.when((F.col("queue_id") == queue_id) & F.col("position").isin(*positions), 1).otherwise(F.col("done")))

