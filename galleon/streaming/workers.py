"""Workers that feed one another: what one stores is what the next one has to do.

Each worker reads some keyed tables, finds what it has not done yet, and stores results in a table of its own; an item
that fails is a row of the failures and isn't tried again until that row goes. A worker is idle while the tables it reads
are the versions that it last found nothing to do in, and wakes when one of them has a new version. All state is in the
tables, so a run that is lost is taken up by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from galleon.sources.keyed import KeyedTable
from galleon.streaming.pipelines import enrich

Keep = Callable[[DataFrame], DataFrame]


class Worker(NamedTuple):
    """name; tables it reads; what there is to do (id), of these tables in that order; results of some ids."""

    name: str
    reads: tuple[str, ...]
    wanted: Callable[..., DataFrame]
    compute: Callable[[list[int]], list[float]]


class Chain:
    """tables: by name, among them one of each worker's name (post_id, score), and failures (post_id, worker, error)."""

    def __init__(self, tables: dict[str, KeyedTable], workers: list[Worker], keep: Keep) -> None:
        self.tables, self.workers, self.keep = tables, workers, keep
        self._idle: dict[str, dict[str, int | None]] = {}

    def pending(self, worker: Worker) -> DataFrame:
        """ids that the worker has neither done nor failed at."""
        done = self.tables[worker.name].read().select(F.col("post_id").alias("id"))
        failed = self.tables["failures"].read().where(F.col("worker") == worker.name).select(F.col("post_id").alias("id"))
        wanted = worker.wanted(*[self.tables[t].read() for t in worker.reads]).select("id").distinct()
        return wanted.join(done, "id", "left_anti").join(failed, "id", "left_anti")

    def step(self, worker: Worker) -> int:
        """Does all that is pending now; the number of items."""
        seen = {t: self.tables[t].version() for t in (*worker.reads, worker.name, "failures")}
        if self._idle.get(worker.name) == seen:
            return 0
        results = self.keep(enrich(self.pending(worker), worker.compute))
        n, bad = results.agg(F.count("*"), F.count("error")).first()
        if n > bad:
            self.tables[worker.name].upsert(results.where("error IS NULL").select("post_id", "score"))
        if bad:
            self.tables["failures"].upsert(results.where("error IS NOT NULL").select("post_id", F.lit(worker.name).alias("worker"), "error"))
        if not n:
            self._idle[worker.name] = seen
        return n

    def drain(self) -> dict[str, int]:
        """All workers in turn until every one is idle; items of each."""
        total = {w.name: 0 for w in self.workers}
        while any([self._count(w, total) for w in self.workers]):
            pass
        return total

    def _count(self, worker: Worker, total: dict[str, int]) -> int:
        n = self.step(worker)
        total[worker.name] += n
        return n
