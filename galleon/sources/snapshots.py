"""State without a table format: versioned Parquet folders, and manifests."""

from __future__ import annotations

import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def create_once(spark: SparkSession, name: str, text: str) -> bool:
    """Makes a whole file, which only one of several writers can do: whether it was this one.

    Atomic where renaming a file onto another one fails, as in HDFS, and on a local disk, where a link does the same; an
    object store needs a file system layer that does.
    """
    fs, path = _fs(spark, name)
    folder, last = name.rsplit("/", 1)
    whole = f"{folder}/.{last}-{uuid.uuid4().hex}"
    fs.mkdirs(path(folder))
    out = fs.create(path(whole), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(urlparse(whole).path, urlparse(name).path)
            done = True
        except FileExistsError:
            done = False
        fs.delete(path(whole), False)
        return done
    done = not fs.exists(path(name)) and fs.rename(path(whole), path(name))
    if not done:
        fs.delete(path(whole), False)
    return done


class VersionedTable:
    """Readers always see one whole version: the newest one that Spark has committed, which its _SUCCESS file tells.

    Versions are named in order of time, so nothing is ever replaced: a writer that is lost leaves a folder that no
    reader takes, and a reader keeps the version that it began with.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> str | None:
        fs, path = _fs(self.spark, self.path)
        if not fs.exists(path(self.path)):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(self.path)))
        return next((v for v in reversed(names) if v.startswith("v") and fs.exists(path(f"{self.path}/{v}/_SUCCESS"))), None)

    def read(self) -> DataFrame:
        if (v := self.version()) is None:
            raise FileNotFoundError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{v}")

    def write(self, df: DataFrame) -> str:
        """A new version; it counts once Spark has committed it."""
        v = f"v{time.time_ns():020d}"
        df.write.parquet(f"{self.path}/{v}")
        return v


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A copy of the state as it is now."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def to_upload(local: DataFrame, remote: DataFrame, since: float | None = None) -> DataFrame:
    """Local files (key, size, mtime) that the store lacks or has in another size; since: only newer ones."""
    new = local if since is None else local.where(F.col("mtime") > since)
    return new.join(remote.select("key", "size"), ["key", "size"], "left_anti")


def to_download(local: DataFrame, remote: DataFrame, since: float | None = None, mirror: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to fetch, local files to delete); only a mirror deletes."""
    new = remote if since is None else remote.where(F.col("mtime") > since)
    extra = local.join(remote.select("key"), "key", "left_anti")
    return new.join(local.select("key", "size"), ["key", "size"], "left_anti"), extra if mirror else extra.limit(0)
