"""Background tasks as a stream with state that expires: finished tasks are kept for an hour, others for a day.

The state of a task is its newest update, with a timer in event time. A newer update moves the timer; when the watermark
passes it, the state goes and a row says so. So the state holds what may still be shown, not all tasks there ever were,
and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Hours that a finished task, and any other one, is kept.
DONE_HOURS, OTHER_HOURS = 1, 24
SCHEMA = "task_id long, seq long, state string, updated_at timestamp"
OUT = "task_id long, state string, updated_us long, gone boolean"


def kept_for(state: str, done_hours: int = DONE_HOURS, other_hours: int = OTHER_HOURS) -> int:
    """Milliseconds."""
    return 3_600_000 * (done_hours if state == "done" else other_hours)


def expiring(updates: DataFrame, done_hours: int = DONE_HOURS, other_hours: int = OTHER_HOURS) -> DataFrame:
    """task_id, state, updated_us, gone of each task that a batch updates or whose time is over.

    updates: a stream of SCHEMA. Of updates of one instant the one with the greatest seq counts; an update that is older
    than the state changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda name, us, gone: pd.DataFrame({"task_id": [key[0]], "state": [name], "updated_us": [us], "gone": [gone]})
        if state.hasTimedOut:
            name, us, _ = state.get
            state.remove()
            yield row(name, us, True)
            return
        best = tuple(state.get) if state.exists else None
        for frame in frames:
            for name, us, seq in zip(frame["state"], frame["us"], frame["seq"], strict=True):
                if best is None or (us, seq) > (best[1], best[2]):
                    best = (name, int(us), int(seq))
        until = best[1] // 1000 + kept_for(best[0], done_hours, other_hours)
        if until <= state.getCurrentWatermarkMs():  # over before it came
            if state.exists:
                state.remove()
            yield row(best[0], best[1], True)
            return
        state.update(best)
        state.setTimeoutTimestamp(until)
        yield row(best[0], best[1], False)

    timed = updates.withColumn("us", F.unix_micros("updated_at")).withWatermark("updated_at", "0 seconds")
    return timed.groupBy("task_id").applyInPandasWithState(step, OUT, "state string, us long, seq long", "update", GroupStateTimeout.EventTimeTimeout)


def retain_tasks(spark: SparkSession, source: str, sink: str, checkpoint: str, done_hours: int = DONE_HOURS, other_hours: int = OTHER_HOURS) -> None:
    """Takes in what is new in a Parquet folder of updates; a batch that is run again overwrites its own folder."""

    def each(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = expiring(spark.readStream.schema(SCHEMA).parquet(source), done_hours, other_hours)
    stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shown_tasks(spark: SparkSession, sink: str) -> DataFrame:
    """task_id, state, updated_at of the tasks that are kept: the newest row of each that isn't gone."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(sink)
    last = rows.groupBy("task_id").agg(F.max_by(F.struct("state", "updated_us", "gone"), "batch").alias("r")).where("NOT r.gone")
    return last.select("task_id", "r.state", F.timestamp_micros("r.updated_us").alias("updated_at"))
