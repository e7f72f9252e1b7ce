"""The directory tree of a scanned library: file counts and score averages of each folder with all below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ancestors(path: Column) -> Column:
    """The folder itself and all above it; '.' is the root."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), above))


def folder_tree(files: DataFrame, averages: DataFrame, private: str = ".private") -> DataFrame:
    """folder, name, parent, direct and total file counts, and the averages of `averages` (folder, ...) where it has them.

    Folders called `private` are left out at any depth, with what is in them. The root's name is empty.
    """
    seen = files.where(~F.array_contains(F.split("file_path", "/"), F.lit(private)) & ~F.coalesce("failed", F.lit(False)))
    direct = seen.groupBy(F.col("file_path").alias("folder")).agg(F.count("*").alias("direct"))
    total = direct.select(F.explode(ancestors(F.col("folder"))).alias("folder"), "direct").groupBy("folder").agg(F.sum("direct").alias("total"))
    parts = F.split("folder", "/")
    up = F.when(F.col("folder") == ".", F.lit(None)).when(F.size(parts) == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    name = F.when(F.col("folder") == ".", "").otherwise(F.element_at(parts, -1))
    return total.join(direct, "folder", "left").join(averages.drop("posts"), "folder", "left").select("folder", name.alias("name"), up.alias("parent"), F.coalesce("direct", F.lit(0)).alias("direct"), "total", *[c for c in averages.columns if c not in ("folder", "posts")])
