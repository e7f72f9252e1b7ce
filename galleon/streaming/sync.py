"""Files that come and go reach the posts: polls of the library, a timer that waits for quiet, one reconciliation at a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galleon.operators.changes import reconcile
from galleon.sources.keyed import Change, KeyedTable
from galleon.sources.lease import SingleFlight
from galleon.sources.watched import FIGURES, SLICES, known_files, watched

#: Fixed value: quiet seconds before a reconciliation.
QUIET = 1.5
KEY = ["file_path", "file_name", "extension"]


def quiet(figures: DataFrame, seconds: float = QUIET) -> DataFrame:
    """One row (changes) for each burst of changes, once that long has passed without another one.

    figures: the stream of `watched`, at most a row of each slice in a batch. The timer is state of the stream, so a
    burst that a restart cuts is still told.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"changes": [n]})
            return
        n = sum(int(f["n"].sum()) for f in frames) + (state.get[0] if state.exists else 0)
        state.update((n,))
        state.setTimeoutDuration(int(seconds * 1000))

    bursts = figures.select((F.col("added") + F.col("removed")).alias("n"), F.lit(0).alias("all")).where("n > 0")
    return bursts.groupBy("all").applyInPandasWithState(step, "changes long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def settle(spark: SparkSession, root: str, state: str, checkpoint: str, slices: int = SLICES) -> dict[str, int]:
    """Polls until two in a row find nothing new (directories are taken up in the poll after the one that lists them); summed figures."""
    total = dict.fromkeys((*FIGURES, "polls"), 0)
    still, over = 0, threading.Event()

    def each(df: DataFrame, _: int) -> None:
        nonlocal still
        if over.is_set():
            return
        row = df.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIGURES]).first()
        for f in FIGURES:
            total[f] += row[f]
        total["polls"] += 1
        still = 0 if row["found"] or row["added"] or row["removed"] else still + 1
        if still == 2:
            over.set()

    query = watched(spark, root, state, slices).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    while not over.wait(0.1):
        if not query.isActive:
            query.awaitTermination()  # raises what ended it
    query.stop()
    return total


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new.where("NOT gone").select(*old.columns))


def sync_posts(files: DataFrame, posts: KeyedTable, keep: Callable[[DataFrame], DataFrame], allow_mass_delete: bool = False) -> dict:
    """Brings posts (id, file_path, file_name, extension), keyed by the last three, in line with the known files.

    New and lost rows go into one version. New ids follow the greatest one, with gaps. The figures are those of the
    reconciliation; deletions under folders that can't be read are left out, too many are held back.
    """
    change: Change = _changed
    version = posts.version()
    have = posts.read(version)
    known = keep(files)
    new, lost, held = reconcile(known.where("NOT failed").select(*KEY), have, known.where("failed").select("file_path"), allow_mass_delete)
    top = have.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new.select((F.lit(top) + 1 + F.monotonically_increasing_id()).alias("id"), *KEY, F.lit(False).alias("gone"))
    rows = keep(fresh.unionByName(lost.select("id", *KEY, F.lit(True).alias("gone"))))
    added, removed = rows.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
    if added or removed:
        posts.merge(rows, change, expect=version)
    return {"added": added, "removed": removed, "held": held}


def auto_sync(spark: SparkSession, root: str, folder: str, posts: KeyedTable, keep: Callable[[DataFrame], DataFrame], every: str = "1 second", seconds: float = QUIET, slices: int = SLICES, done: Callable[[dict], None] | None = None):
    """The running query: a reconciliation at its start and after each burst of changes; `folder` is a shared one."""
    flight = SingleFlight(spark, f"{folder}/flight")

    def work(turn: int, rerun: bool) -> None:
        result = sync_posts(known_files(spark, root, f"{folder}/watch", slices), posts, keep)
        if done:
            done(result | {"turn": turn, "rerun": rerun})

    def each(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            flight.run(work)

    settle(spark, root, f"{folder}/watch", f"{folder}/settled-{uuid.uuid4().hex}", slices)
    flight.run(work)
    stream = quiet(watched(spark, root, f"{folder}/watch", slices), seconds)
    return stream.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", f"{folder}/stream").trigger(processingTime=every).start()
