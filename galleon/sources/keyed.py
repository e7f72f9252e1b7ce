"""Keyed tables without a table format: buckets of Parquet files, a manifest for each version, merges that copy on write.

A version is a manifest: the folder of each bucket, and a few facts about the version. A merge reads and writes the
buckets that its keys fall into, and names the other ones' folders again. It commits by putting its manifest under the
next number, which only one of several writers can do; the others take their work over to the new version if their
buckets are as they were, or else do it again. Nothing is ever replaced, so readers keep the version they began with, and
a writer that is lost leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from galleon.sources.snapshots import _fs, create_once

Change = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(Exception):
    """Another writer was first, and the work can't be taken over."""


def replaced(keys: list[str]) -> Change:
    """New rows take the place of old ones of their keys."""
    return lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def removed(keys: list[str]) -> Change:
    return lambda old, gone: old.join(gone.select(*keys), keys, "left_anti")


class KeyedTable:
    """keys tell rows apart; rows are dealt into buckets by a hash of `by`, the keys or some of them.

    Manifests are as long as there are buckets. Commits are as atomic as `create_once`.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.by, self.buckets = spark, path.rstrip("/"), keys, by or keys, buckets

    # --- manifests ---

    def version(self) -> int | None:
        fs, path = _fs(self.spark, self.path)
        if not fs.exists(path(f"{self.path}/manifests")):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/manifests"))]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """schema, folders (bucket -> folder) and facts of a version, the newest unless given."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version in {self.path}")
        fs, path = _fs(self.spark, self.path)
        stream = fs.open(path(f"{self.path}/manifests/v{version:012d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": version}

    def facts(self) -> dict:
        return self.manifest()["facts"] if self.version() is not None else {}

    def _commit(self, version: int, manifest: dict) -> bool:
        return create_once(self.spark, f"{self.path}/manifests/v{version:012d}", json.dumps(manifest))

    # --- reading ---

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some of its buckets."""
        m = self.manifest(version)
        schema = StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{f}" for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def differing(self, since: int | None, until: int) -> set[int]:
        """Buckets that aren't the same files in both versions; all of them, if there is no earlier one."""
        if since is None:
            return set(range(self.buckets))
        a, b = self.manifest(since)["folders"], self.manifest(until)["folders"]
        return {int(k) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}

    # --- writing ---

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def _stored(self, rows: DataFrame) -> dict[str, str]:
        """Writes the rows; the folder of each bucket that has some."""
        folder = f"files/{uuid.uuid4().hex}"
        self._placed(rows).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, path = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def create(self, rows: DataFrame, facts: dict | None = None) -> int:
        if not self._commit(0, {"schema": json.loads(rows.schema.json()), "folders": self._stored(rows), "facts": facts or {}}):
            raise Conflict(f"there is a table in {self.path}")
        return 0

    def merge(self, new: DataFrame, change: Change, facts: dict | None = None, expect: int | None = None, tries: int = 20) -> int:
        """The version in which change(old rows, new rows) holds for the buckets of the new rows.

        `change` must keep rows in their buckets. With `expect` the merge holds for that version only: if there is a
        newer one, it ends in a Conflict.
        """
        touched = {r[0] for r in self._placed(new).select("_bucket").distinct().collect()}  # as many as buckets, at most
        made, base = None, None
        for _ in range(tries):
            m = self.manifest()
            if expect is not None and m["version"] != expect:
                raise Conflict(f"{self.path} is at version {m['version']}, not {expect}")
            own = {b: m["folders"].get(str(b)) for b in touched}
            if made is None or own != base:  # else what was written holds for the new version as well
                base = own
                made = self._stored(change(self.read(m["version"], touched), new)) if touched else {}
            folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | made
            if self._commit(m["version"] + 1, {"schema": m["schema"], "folders": folders, "facts": m["facts"] if facts is None else facts}):
                return m["version"] + 1
        raise Conflict(f"{tries} writers were faster in {self.path}")

    def upsert(self, new: DataFrame, **more) -> int:
        return self.merge(new, replaced(self.keys), **more)

    def delete(self, gone: DataFrame, **more) -> int:
        """gone: the keys of rows that go."""
        return self.merge(gone, removed(self.keys), **more)
