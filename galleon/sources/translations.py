"""Translations of tag names: one JSON file per language, searched by what people type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "name string, display string"


def languages(spark: SparkSession, folder: str) -> list[str]:
    """Languages that the folder has a file of; nothing else is ever opened."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName()[: -len(".json")] for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))


def table(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """name, display; empty for a language without a file. A file is one JSON object of names and displays."""
    if language not in languages(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    text = spark.read.text(f"{folder}/{language}.json", wholetext=True)
    return text.select(F.explode_outer(F.from_json("value", "map<string,string>")).alias("name", "display")).where("name IS NOT NULL")


def names_like(translations: DataFrame, query: str, limit: int = 5000) -> DataFrame:
    """Names whose display holds the query, whatever its case; the limit bounds what is put into a filter."""
    return translations.where(F.lower("display").contains(query.lower())).orderBy("name").limit(limit).select("name")
