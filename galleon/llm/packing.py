"""Best-fit packing: documents as token ids, put into as few sequences of LENGTH tokens as possible.

Bulk-synchronous best fit. Pieces are range-sorted by length, so a piece's place in its size class, its rank, is its
place in its partition plus what earlier partitions hold of the class. Gaps are kept as classes too: intervals of
sequences that are open and have the same room left. A superstep takes the longest size class not yet placed: all
its pieces and all gaps meet in one sweep, each piece's successor being the smallest gap it fits into; pieces that
want the same gap are told apart by rank, the gap's new size goes back among the gaps, and the next superstep
follows. Pieces of a size are alike, so a sweep needs only the numbers of pieces and gaps of each size: at most
LENGTH of them, however large the corpus is. The sweeps yield intervals of ranks; joined with the ranked pieces they
give every piece's sequence and place. The result equals best fit with the longest pieces first.

Null and empty texts are one end id. A document of more than LENGTH ids is cut into pieces of LENGTH, the rest
standing first. Repeated rows are packed each. No rows: no sequences. A size class with a third of all pieces is
spread over many partitions, since the range sort goes on with the id.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from galleon.llm.base import mapped, table, written
from galleon.llm.tokens import encoder, vocabulary

LENGTH = 2048
END = (0).to_bytes(4, "little")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Every document's pieces: doc_id, row (a number of its own for each row), piece, start, length, ids_crc32."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path, False)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
            ids, count = enc.encode(b.column("text").to_pylist())
            data, at = memoryview(ids.astype("<u4", copy=False).tobytes()), 0
            for doc, row, n in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), count.tolist(), strict=True):
                pieces = cut(n + 1)
                for k, (start, size) in enumerate(pieces):
                    last = k == len(pieces) - 1  # the end id isn't among the encoder's
                    crc = zlib.crc32(data[at + 4 * start : at + 4 * (start + size - last)])
                    for key, v in zip(out, (doc, row, k, start, size, zlib.crc32(END, crc) if last else crc), strict=True):
                        out[key].append(v)
                at += 4 * n
            yield out

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return mapped(rows, step, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def sweep(count: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Where the ranks of each size class go: (size, first rank, how many, first sequence, pieces in a sequence, offset).

    The sequences of an interval follow each other and take the same number of pieces of the size, but for the last.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: intervals (first sequence, how many)
    open_: list[int] = []  # the rooms there are, ascending
    out, made = [], 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                bisect.insort(open_, room)
            gaps.setdefault(room, []).append((first, n))

    for size in sorted(count, reverse=True):
        rank, left = 0, count[size]

        def place(room: int, first: int, n: int, size: int = size) -> None:
            """Fills up to n equal gaps, each as far as it goes, and frees what stays."""
            nonlocal rank, left
            fit = room // size
            full, rest = (n, 0) if left >= n * fit else divmod(left, fit)
            took = full * fit + rest
            out.append((size, rank, took, first, fit, length - room))
            free(room - fit * size, first, full)
            if rest:
                free(room - rest * size, first + full, 1)
            used = full + bool(rest)
            free(room, first + used, n - used)
            rank, left = rank + took, left - took

        while left and (at := bisect.bisect_left(open_, size)) < len(open_):
            room = open_[at]
            first, n = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], open_[at]
            place(room, first, n)
        if left:
            n = -(-left // (length // size))
            made += n
            place(length, made - n, n)
    return out


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence_id and the offset there."""
    spark = docs.sparkSession
    found = written(pieces(docs, path or vocabulary("byte_bpe_50k.json")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            local = []
            for n in b.column("length").to_pylist():
                at = at + 1 if n == size else 0
                size = n
                local.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*b.schema.names, "part", "local"])

    order = (F.desc("length"), "doc_id", "row", "piece")
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part int, local long"
    ranked = written(found.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema))
    # a size class lies in partitions that follow each other: (part, length) has at most parts + LENGTH rows
    counts = ranked.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    names = "length long, first long, n long, sequence long, fit long, room long"
    plan = spark.createDataFrame(sweep(total), names)
    rank = F.col("before") + F.col("local")
    nth = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(before), ["part", "length"])  # at most parts + LENGTH rows, as said
        .withColumn("rank", rank)
        .join(F.broadcast(plan.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div fit")).alias("sequence_id"), (F.col("room") + nth % F.col("fit") * F.col("length")).alias("offset"))
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
