"""What the training-data operators share: reading, shared scratch tables, Arrow maps and label handling."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Lower-cases A-Z of UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows and bytes of an Arrow batch: texts can be long, and a Python worker has little memory.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; sets the batch size for the Arrow maps that will read it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes, null as empty; other columns go, whatever their names."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def shared(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder; Spark deletes it when the session's JVM ends.

    Only a local session may do without such a folder: its executors are this machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/galleon"
    path = f"{top.rstrip('/')}/galleon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


#: Spark removes a query's shuffle files when the query ends, where this is on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, *parts: str, buckets: tuple[int, str] | None = None) -> None:
    """Writes the frame as Parquet, in buckets of a column if asked. What it shuffled goes from the disks at once:
    nobody reads it again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        if buckets:  # Spark writes buckets of tables only; the table's name goes, its files stay
            name = f"stored_{uuid.uuid4().hex}"
            df.write.partitionBy(*parts).bucketBy(*buckets).format("parquet").option("path", path).saveAsTable(name)
            spark.sql(f"DROP TABLE {name}")
        else:
            df.write.partitionBy(*parts).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, and a lost executor costs nothing already written."""
    path = path or f"{shared(df.sparkSession)}/table"
    stored(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow by a function that yields columns as dicts of lists; the schema's types are used as they are."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [arrow_type(x.split()[1]) for x in schema.split(",")]
    fields = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=k) for n, k in zip(names, kinds, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def arrow_type(name: str) -> pa.DataType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "short": pa.int16(), "byte": pa.int8()}
    return pa.list_(arrow_type(name[6:-1])) if name.startswith("array<") else kinds[name]


def held_out(doc_id: int | None) -> bool:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("None")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and label of at most `rows` labelled documents that aren't held out, chosen by a hash of the id.

    The sample's ids are the only thing that is broadcast; their number is bounded by `rows`. Documents that share an
    id don't make it more rows.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column())
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fitted(sample: DataFrame, fit: Callable[[list[int], list[bytes], list[int]], bytes]) -> bytes:
    """What `fit` makes of a bounded sample, in one task of an executor: only the model reaches the driver."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, label = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            found += b.column("text").to_pylist()
            label += b.column("label").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], found[i]))
        yield pa.RecordBatch.from_pydict({"model": [fit([ids[i] for i in order], [found[i] for i in order], [label[i] for i in order])]})

    found = sample.repartition(1).mapInArrow(step, "model binary").collect()
    return bytes(found[0][0]) if found else fit([], [], [])
