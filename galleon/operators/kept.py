"""Figures kept beside keyed tables: counts of tags and the comparison graph follow changes instead of being made anew.

Each kept table says in its facts which versions of its sources it holds. A refresh reads the buckets that differ
between those versions and the newest ones, nets what changed per key, and commits figures and facts as one version: a
refresh that is lost, or runs twice, leaves them right.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from galleon.operators.annotations import win_loss
from galleon.operators.graph import connected_components
from galleon.sources.keyed import Conflict, KeyedTable

Keep = Callable[[DataFrame], DataFrame]


def added(columns: list[str], key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A change of a keyed table: figures of a key are added up; where all are 0, the row goes."""

    def change(old: DataFrame, delta: DataFrame) -> DataFrame:
        sums = old.unionByName(delta.select(*old.columns)).groupBy(key).agg(*[F.sum(c).cast(dict(old.dtypes)[c]).alias(c) for c in columns])
        return sums.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])).select(*old.columns)

    return change


class TagCounts:
    """Canonical posts of each tag. links (post_id, tag_name) and posts (id, canonical_post_id) are keyed tables with as
    many buckets each, dealt out by the post; counts (name, post_count) is the kept one."""

    def __init__(self, links: KeyedTable, posts: KeyedTable, counts: KeyedTable) -> None:
        if links.buckets != posts.buckets or links.by != ["post_id"] or posts.by != ["id"]:
            raise ValueError("links and posts must be dealt out alike, by the post")
        self.links, self.posts, self.counts = links, posts, counts

    def visible(self, at: dict, buckets: set[int]) -> DataFrame:
        """Links of canonical posts in some buckets of given versions."""
        lead = self.posts.read(at["posts"], buckets).where("canonical_post_id IS NULL").select(F.col("id").alias("post_id"))
        return self.links.read(at["links"], buckets).join(lead, "post_id", "left_semi").select(F.col("tag_name").alias("name"))

    def refresh(self) -> int:
        """The number of buckets that were read; 0 if nothing was new. Of two at a time one counts, the other looks again."""
        while True:
            version = self.counts.version()
            was, now = self.counts.facts() or None, {"links": self.links.version(), "posts": self.posts.version()}
            if was == now:
                return 0
            touched = set().union(*[getattr(self, t).differing(was and was[t], now[t]) for t in ("links", "posts")])
            delta = self.visible(now, touched).withColumn("d", F.lit(1))
            if was:
                delta = delta.unionByName(self.visible(was, touched).withColumn("d", F.lit(-1)))
            net = delta.groupBy("name").agg(F.sum("d").alias("post_count")).where("post_count <> 0")
            try:
                if version is None:
                    self.counts.create(net, now)
                else:
                    self.counts.merge(net, added(["post_count"], "name"), now, expect=version)
                return len(touched)
            except Conflict:
                continue


class ComparisonGraph:
    """Degrees, wins, losses and components of judged posts, kept up to date from new verdicts of one dimension.

    nodes: keyed table of id, component, degree, wins, losses. New verdicts are contracted to the components that their
    ends belong to, so the search for components runs over edges between components; then nodes of components that got
    another name change it. A batch's number is a fact of the version, so a batch that comes again changes nothing.
    """

    def __init__(self, nodes: KeyedTable, keep: Keep) -> None:
        self.nodes, self.keep = nodes, keep

    def add(self, verdicts: DataFrame, batch: int) -> bool:
        """verdicts: post_a, post_b, winner of batch number `batch`; False if it was there already."""
        version = self.nodes.version()
        if version is not None and batch <= self.nodes.facts()["batch"]:
            return False
        old = self.nodes.read(version) if version is not None else verdicts.sparkSession.createDataFrame([], "id long, component long, degree long, wins long, losses long")
        judged = self.keep(verdicts.where("winner <> 'skip'").select(F.col("post_a").cast("long").alias("post_a"), F.col("post_b").cast("long").alias("post_b"), "winner"))
        mine = self.keep(win_loss(judged, None).select(F.col("post_id").alias("id"), F.col("degree").alias("_degree"), F.col("wins").alias("_wins"), F.col("losses").alias("_losses")))
        known = self.keep(mine.join(old.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
        end = lambda x: known.select(F.col("id").alias(f"post_{x}"), F.col("component").alias(x))
        between = judged.join(end("a"), "post_a").join(end("b"), "post_b").select("a", "b").where("a <> b").distinct()
        named = self.keep(connected_components(between, self.keep).where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("_new")))
        # nodes that a verdict names, and those of components with another name
        moved = old.join(named.select("component"), "component", "left_semi").select("id", "component")
        touched = known.unionByName(moved.join(known, "id", "left_anti"))
        fresh = touched.join(named, "component", "left").select("id", F.coalesce("_new", "component").alias("component")).join(mine, "id", "left")
        rows = fresh.join(old.drop("component"), "id", "left").select("id", "component", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in ("degree", "wins", "losses")])
        if version is None:
            self.nodes.create(rows, {"batch": batch})
        else:
            self.nodes.upsert(rows, facts={"batch": batch}, expect=version)
        return True


class TimelineHead:
    """The newest rows of a timeline, k of them to be shown and some more in reserve, kept from inserts, edits and deletes.

    events: keyed by kind and id, with the timeline's columns; head: a keyed table of the same rows, in one bucket. A
    refresh takes the rows of buckets that changed and the head's own rows of the others. Rows outside the head are older
    than its last one, so that is exact while k rows no older than it are left; when deletes have used up the
    reserve, it is filled again from rows below.
    """

    def __init__(self, events: KeyedTable, head: KeyedTable, k: int, reserve: int | None = None) -> None:
        self.events, self.head, self.k, self.size = events, head, k, k + (k if reserve is None else reserve)

    def _first(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("created_at"), F.desc("kind"), F.desc("id")).limit(self.size)

    def refresh(self) -> str:
        """"same", "kept" (from what changed) or "filled" (from all rows)."""
        now = self.events.version()
        if self.head.version() is None:
            rows = self._first(self.events.read(now))
            self.head.create(rows, self._facts(rows, now))
            return "filled"
        version, facts = self.head.version(), self.head.facts()
        if facts["events"] == now:
            return "same"
        touched = self.events.differing(facts["events"], now)
        old = self.head.read(version)
        rest = self.events._placed(old).where(~F.col("_bucket").isin(*touched)).drop("_bucket")
        rows = self._first(rest.unionByName(self.events.read(now, touched).select(*old.columns)))
        how = "kept"
        if facts["last"] is not None:  # there are rows below the head
            kind, at, number = facts["last"]
            last = F.struct(F.timestamp_micros(F.lit(at)), F.lit(kind), F.lit(number).cast("bigint"))
            rows = rows.where(F.struct("created_at", "kind", "id") >= last)
            if rows.count() < self.k:
                rows, how = self._first(self.events.read(now)), "filled"
        self.head.merge(rows, lambda _, new: new, self._facts(rows, now), expect=version) if not rows.isEmpty() else self.head.delete(old, facts=self._facts(rows, now), expect=version)
        return how

    def _facts(self, rows: DataFrame, now: int) -> dict:
        """The events' version, and the head's last row if there can be rows below it."""
        n = rows.count()
        below = n < self.size and self.events.read(now).count() == n
        last = None if below or not n else rows.orderBy("created_at", "kind", "id").select("kind", F.unix_micros("created_at"), "id").first()
        return {"events": now, "last": None if last is None else list(last)}

    def page(self) -> DataFrame:
        return self.head.read().orderBy(F.desc("created_at"), F.desc("kind"), F.desc("id")).limit(self.k)
