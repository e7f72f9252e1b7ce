"""Groups of near vectors kept up to date: new vectors are compared with all, then only what they change is decided anew.

Equal vectors are one class, named by the first of its posts that came, so its edges stay when others join it. Classes
are decided in the order of their smallest post: a class leads unless a class before it that leads is near. A decision
depends on nearer-to-the-front neighbours only, so a batch touches classes that have a new edge to one in front or whose
front post changed, and whatever hangs on a decision that fell differently. The result is what a rebuild from all
vectors gives.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from galleon.operators import metric
from galleon.operators.dedup import assign_canonicals
from galleon.sources.keyed import KeyedTable

Keep = Callable[[DataFrame], DataFrame]
#: After so many rounds of a batch, what is open is decided by a pass over all edges: long chains take a round a link.
ROUNDS = 12


class NearGroups:
    """Tables in a folder: classes (digest, cls, front), members (post_id, cls), edges (cls, other) both ways, leads (cls, lead),
    and the blocks of every batch. A batch counts once `leads` names it; one that is lost before is done again whole."""

    def __init__(self, spark: SparkSession, path: str, threshold: float, keep: Keep, buckets: int = 64, block: int = metric.BLOCK) -> None:
        self.spark, self.path, self.threshold, self.keep, self.block = spark, path.rstrip("/"), threshold, keep, block
        self.radius = math.sqrt(2 * max(threshold, 0.0))
        table = lambda name, keys, by=None: KeyedTable(spark, f"{self.path}/{name}", keys, by, buckets)
        self.classes, self.members = table("classes", ["digest"]), table("members", ["post_id"])
        self.edges, self.leads = table("edges", ["cls", "other"], ["cls"]), table("leads", ["cls"])

    def batches(self) -> int:
        return self.leads.facts()["batches"] if self.leads.version() is not None else 0

    def _start(self, units: DataFrame) -> None:
        centres = metric.pivots_of(units, block=self.block)
        facts = {"pivots": base64.b64encode(centres.tobytes()).decode(), "width": centres.shape[1] if len(centres) else 0}
        frame = lambda kind: self.spark.createDataFrame([], kind)
        for t, kind in ((self.classes, "digest string, cls long, front long"), (self.members, "post_id long, cls long"), (self.edges, "cls long, other long")):
            if t.version() is None:
                t.create(frame(kind), facts if t is self.classes else None)
        self.leads.create(frame("cls long, lead boolean"), {"batches": 0})

    def _blocks(self, first: int, last: int) -> DataFrame | None:
        folders = [f"{self.path}/blocks/{b}" for b in range(first, last)]
        return self.spark.read.parquet(*folders) if folders else None

    def add(self, vectors: DataFrame) -> int:
        """Takes in a batch of new posts' vectors (post_id, embedding), in whatever order of ids; the number of batches so far.

        A post that is there already stays with the vector it has.
        """
        units = metric.units_of(vectors).dropDuplicates(["post_id"])
        if self.leads.version() is None:
            if units.isEmpty():
                return 0
            self._start(units)
        number, version = self.batches(), self.leads.version()
        facts = self.classes.facts()
        centres = np.frombuffer(base64.b64decode(facts["pivots"])).reshape(-1, facts["width"])

        digest = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256)
        came = self.keep(units.withColumn("digest", digest).join(self.members.read().select("post_id"), "post_id", "left_anti"))
        old = self.classes.read()
        new = came.groupBy("digest").agg(F.min(F.struct("post_id", "v")).alias("m")).select("digest", F.col("m.post_id").cast("long").alias("least"), F.col("m.v").alias("v"))
        joined = self.keep(new.join(old, "digest", "left").withColumns({"fresh": F.col("cls").isNull(), "moved": F.col("least") < F.col("front")}))
        named = joined.select("digest", F.coalesce("cls", "least").alias("cls"), F.least("least", F.coalesce("front", "least")).alias("front"))
        fresh = joined.where("fresh").select(F.col("least").alias("post_id"), "v")

        where = f"{self.path}/blocks/{number}"
        metric.packed(fresh, centres, self.radius, self.block, first=number << 44).write.mode("overwrite").parquet(where)
        blocks, mine = self._blocks(0, number + 1), self._blocks(number, number + 1)
        pairs = metric.multiplied(blocks, metric.meeting(blocks, self.radius, mine), self.threshold)
        links = self.keep(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("other")), F.struct(F.col("b").alias("cls"), F.col("a").alias("other")))).alias("e")).select("e.*"))

        self.classes.upsert(named)
        self.members.upsert(came.select(F.col("post_id").cast("long").alias("post_id"), "digest").join(named.select("digest", "cls"), "digest").select("post_id", "cls"))
        self.edges.upsert(links)
        self.leads.upsert(self._decided(links, joined.where("moved").select("cls")), facts={"batches": number + 1}, expect=version)
        return number + 1

    def _ordered(self) -> DataFrame:
        """(cls, other, front, front_other) of every edge, both ways."""
        front = self.classes.read().select("cls", "front")
        other = front.select(F.col("cls").alias("other"), F.col("front").alias("front_other"))
        return self.edges.read().join(front, "cls").join(other, "other")

    def _decided(self, links: DataFrame, moved: DataFrame) -> DataFrame:
        """(cls, lead) of all classes that were decided in this batch, those whose decision stays as it was included."""
        edges = self.keep(self._ordered())
        behind = lambda of: edges.join(of.select("cls"), "cls", "left_semi").where("front_other > front").select(F.col("other").alias("cls"))
        ends = edges.join(links, ["cls", "other"], "left_semi")
        todo = self.keep(ends.where("front_other < front").select("cls").union(moved).union(behind(moved)).distinct())
        before = self.leads.read()
        done = self.keep(ends.select("cls").distinct().join(before, "cls", "left_anti").select("cls", F.lit(True).alias("lead")))  # without an edge so far
        for _ in range(ROUNDS):
            if todo.isEmpty():
                return done
            ahead = self.keep(edges.where("front_other < front").join(todo, "cls", "left_semi"))
            waits = ahead.join(todo.select(F.col("cls").alias("other")), "other", "left_semi").select("cls").distinct()
            ready = todo.join(waits, "cls", "left_anti")
            now = before.join(done.select("cls"), "cls", "left_anti").unionByName(done)
            led = ahead.join(now.where("lead").select(F.col("cls").alias("other")), "other", "left_semi").select("cls").distinct().withColumn("led", F.lit(True))
            fell = self.keep(ready.join(led, "cls", "left").join(now, "cls", "left").select("cls", F.col("led").isNull().alias("lead"), F.coalesce("lead", F.lit(True)).alias("was")))
            done = self.keep(done.join(fell.select("cls"), "cls", "left_anti").unionByName(fell.select("cls", "lead")))
            todo = self.keep(todo.join(fell, "cls", "left_anti").union(behind(fell.where("lead <> was"))).distinct())
        return self._all(edges)

    def _all(self, edges: DataFrame) -> DataFrame:
        """Every class with an edge, decided by a pass over all edges."""
        members = assign_canonicals(edges.where("front < front_other").select(F.col("front").alias("a"), F.col("front_other").alias("b")), self.keep).select(F.col("member").alias("front"))
        return edges.select("cls", "front").distinct().join(members.withColumn("led", F.lit(True)), "front", "left").select("cls", F.col("led").isNull().alias("lead"))

    def groups(self) -> DataFrame:
        """(member, canonical) of all posts that don't lead."""
        if self.leads.version() is None:
            return self.spark.createDataFrame([], "member long, canonical long")
        leads = self.leads.read()
        led = self._ordered().where("front_other < front").join(leads.where("lead").select(F.col("cls").alias("other")), "other", "left_semi").groupBy("cls").agg(F.min("front_other").alias("canonical"))
        canon = self.classes.read().select("cls", "front").join(led.join(leads.where("NOT lead"), "cls", "left_semi"), "cls", "left").select("cls", F.coalesce("canonical", "front").alias("canonical"))
        return self.members.read().join(canon, "cls").where("post_id <> canonical").select(F.col("post_id").alias("member"), "canonical")
