"""Enrichment as Structured Streaming: micro-batches of new posts, keyed sinks, a ladder for failing batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def ladder(run: Callable[[list], list], items: list, steps: tuple[int, ...] = (4, 1)) -> tuple[list, list[tuple]]:
    """(results, failures): a batch that fails is tried in smaller ones; an item that fails alone is a failure."""
    try:
        return list(run(items)), []
    except Exception as e:  # noqa: BLE001
        if len(items) <= 1 or not steps:
            return [], [(i, f"{type(e).__name__}: {e}") for i in items]
    done, failed = [], []
    size = min(steps[0], max(1, len(items) - 1))
    for lo in range(0, len(items), size):
        ok, bad = ladder(run, items[lo : lo + size], steps[1:])
        done, failed = done + ok, failed + bad
    return done, failed


def enrich(df: DataFrame, compute: Callable[[list[int]], list[float]], batch: int = 16) -> DataFrame:
    """post_id, score, error of each id: failures come back as data."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows = frame["id"].tolist(), []
            for lo in range(0, len(ids), batch):
                part = ids[lo : lo + batch]
                ok, bad = ladder(lambda xs: list(zip(xs, compute(xs), strict=True)), part)
                rows += [(i, float(s), None) for i, s in ok] + [(i, None, e) for i, e in bad]
            yield pd.DataFrame(rows, columns=["post_id", "score", "error"]).astype({"score": "float64"})

    return df.select("id").mapInPandas(step, "post_id long, score double, error string")


def run_backfill(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, compute: Callable[[list[int]], list[float]], on_drained: Callable[[], None] | None = None, every: str | None = None):
    """Everything new in a Parquet folder goes through `compute` into sink/batch=n, each id once.

    Ids that came before are kept in the stream's own state, so a batch costs what is new in it; a batch that is run
    again overwrites its own folder. Without `every` what is there is drained, on_drained is called and the number of
    batches returned; with it ("30 seconds") the running query is returned, which looks for new files that often. One
    checkpoint has one query at a time: Spark refuses a second one.
    """
    seen: list[int] = []

    def each(df: DataFrame, batch_id: int) -> None:
        enrich(df, compute).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        seen.append(batch_id)

    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates(["id"])
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    if on_drained:
        on_drained()
    return len(seen)


def batch_key(ids: list[int]) -> str:
    """The same members are the same batch."""
    return ",".join(map(str, sorted(ids)))


def progressed(last: list[int] | None, now: list[int]) -> bool:
    return bool(now) and (last is None or batch_key(last) != batch_key(now))


def stream_tag_counts(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> DataFrame:
    """Running counts of a stream of tag links, drained: each batch writes the tags that changed, the newest row counts."""

    def each(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    counts = spark.readStream.schema(schema).parquet(source).groupBy("tag_name").agg(F.count("*").alias("n"))
    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("tag_name").agg(F.max_by("n", "batch").alias("n"))


def watch(spark: SparkSession, source: str, schema: str, changed: Callable[[DataFrame], None], checkpoint: str, every: str = "10 minutes"):
    """Calls `changed` with the new rows of a folder of manifests, looked for as often as said; returns the running query."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: changed(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def retained(tasks: DataFrame, now, done_hours: int = 1, other_hours: int = 24) -> DataFrame:
    """Tasks (state, updated_at) that are kept: finished ones for an hour, all others for a day."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 3600
    return tasks.where(age <= F.when(F.col("state") == "done", done_hours).otherwise(other_hours))


class TimelineView:
    """Head of a timeline held by a reader: entries are put in front, taken out or changed in place."""

    def __init__(self, entries: list[dict]) -> None:
        self.entries = list(entries)

    def prepend(self, entry: dict) -> None:
        self.entries = [entry, *[e for e in self.entries if (e["kind"], e["id"]) != (entry["kind"], entry["id"])]]

    def remove(self, keys: set[tuple]) -> None:
        self.entries = [e for e in self.entries if (e["kind"], e["id"]) not in keys]

    def patch(self, kind: str, number: int, **changes) -> None:
        self.entries = [e | changes if (e["kind"], e["id"]) == (kind, number) else e for e in self.entries]
