"""Exact top-k search by inner product over norm buckets.

Vectors are sorted by length and cut into buckets of like length. A query first meets the bucket of the longest
vectors; its k-th best product there is a threshold that every later answer must reach. In each other bucket the
threshold, divided by the query's length and the bucket's longest vector, is a cosine. Above 1 the bucket is passed
over whole. A high cosine gives narrow intervals for a vector's largest coordinates: only vectors inside them are
verified (coordinate pruning). A lower one bounds a vector's length only (length pruning). What is left is verified by
exact products. Queries travel in blocks, buckets as one row each; a block meets a bucket once, and only if some query of it
can reach its threshold there: blocks and buckets are first paired without their matrices.

Components are floor(64 * x). Products are exact for components of any size: where lengths say that a sum could pass
what a double holds exactly, what may be among the answers is multiplied again in whole numbers. A score that no long
holds is an error. Vectors that are null, or hold null or non-finite components, and rows without a vec_id take no
part. Shorter vectors count as if filled up with zeros. Rows with a query's vec_id are its own and no answers; of
equal scores the smaller vec_id comes first. Fewer candidates than k: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from galleon.llm.base import mapped, table, written

K, EVERY, BUCKET, BLOCK = 20, 20, 16_384, 1024
#: From this cosine on the coordinate intervals prune more than they cost.
NARROW, FOCUS = 0.8, 3
#: Below this length times length all sums are exact in doubles.
EXACT = float(1 << 53)

ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, row, norm and the floored components, as bytes of 32-bit integers or, if wide, of doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", F.monotonically_increasing_id().alias("row"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            lists = b.column("x")
            v = np.floor(64 * np.asarray(lists.flatten(), np.float64))
            if not np.isfinite(v).all():
                raise OverflowError("64 times a component is beyond what a double holds")
            at = np.asarray(lists.offsets).astype(np.int64)
            spans = list(zip(at - at[0], at[1:] - at[0], strict=False))
            wide = [bool(j > i and np.abs(v[i:j]).max() >= 1 << 31) for i, j in spans]
            norm = [float(np.linalg.norm(v[i:j])) for i, j in spans]
            yield {"vec_id": b.column("vec_id"), "row": b.column("row"), "norm": norm, "wide": wide, "x": [v[i:j].astype("<f8" if w else "<i4").tobytes() for (i, j), w in zip(spans, wide, strict=True)]}

    return mapped(rows, step, "vec_id long, row long, norm double, wide boolean, x binary")


def stacked(rows: list[bytes], wide: list[bool]) -> np.ndarray:
    """The vectors as rows of doubles, filled up with zeros to the longest of them."""
    v = [np.frombuffer(r, "<f8" if w else "<i4") for r, w in zip(rows, wide, strict=True)]
    out = np.zeros((len(v), max(map(len, v), default=0)))
    for o, r in zip(out, v, strict=True):
        o[: len(r)] = r
    return out


def blocks(rows: DataFrame, n: int, order: list) -> DataFrame:
    """One row per range partition: bucket, width, longest, wide, ids, rows, norms and the matrix, in this order."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: dict[str, list] = {k: [] for k in ("vec_id", "row", "norm", "wide", "x")}
        for b in batches:
            for k, v in found.items():
                v += b.column(k).to_pylist()
        if found["row"]:
            m, wide = stacked(found["x"], found["wide"]), any(found["wide"])
            yield {
                "bucket": [TaskContext.get().partitionId()], "width": [m.shape[1]], "longest": [max(found["norm"])], "wide": [wide],
                "ids": [np.array(found["vec_id"], "<i8").tobytes()], "rows": [np.array(found["row"], "<i8").tobytes()], "norms": [np.array(found["norm"], "<f8").tobytes()], "m": [m.astype("<f8" if wide else "<i4").tobytes()],
            }

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return mapped(dealt, step, "bucket int, width int, longest double, wide boolean, ids binary, rows binary, norms binary, m binary")


def matrix(m: bytes, wide: bool, n: int, width: int, most: int) -> np.ndarray:
    """A block's matrix as doubles, filled up with zeros to `most` columns."""
    out = np.zeros((n, most))
    if width:
        out[:, :width] = np.frombuffer(m, "<f8" if wide else "<i4").reshape(n, width)
    return out


def answers(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query's place, vec_id, product): each query's k best of one bucket that reach its floor."""
    out: tuple[list, list, list] = ([], [], [])
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    longest = c_len.max(initial=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_len * longest > 0, floor / (q_len * longest), np.where(floor > 0, np.inf, -np.inf))
        need = np.where(q_len > 0, floor / q_len, np.where(floor > 0, np.inf, -np.inf))
    unit = c / np.where(c_len > 0, c_len, 1)[:, None]
    by_length = [i for i in range(len(q)) if cosine[i] <= 1 + 1e-9 and cosine[i] < NARROW]
    by_coordinate = [i for i in range(len(q)) if NARROW <= cosine[i] <= 1 + 1e-9]

    def take(i: int, at: np.ndarray, score: np.ndarray) -> None:
        # what rounding can add up to, where sums aren't exact
        loose = 0.0 if q_len[i] * longest < EXACT else (q.shape[1] + 2) * 2.0**-52 * q_len[i] * longest
        keep = (c_ids[at] != q_ids[i]) & (score >= floor[i] - loose)
        at, score = at[keep], score[keep]
        if len(at) > 4 * k:  # more than enough: all that reach the k-th best, ties included
            cut = np.partition(score, len(score) - k)[len(score) - k] - 2 * loose
            at, score = at[score >= cut], score[score >= cut]
        if loose:
            whole = list(map(int, q[i]))
            exact = [sum(a * int(b) for a, b in zip(whole, c[j], strict=True)) for j in at.tolist()]
            best = sorted(range(len(at)), key=lambda j: (-exact[j], int(c_ids[at[j]])))[:k]
            if any(not -(1 << 63) <= exact[j] < 1 << 63 for j in best):
                raise OverflowError("a score is beyond what a long holds")
            chosen = [exact[j] for j in best]
        else:
            best = np.lexsort((c_ids[at], -score))[:k]
            chosen = score[best].astype(np.int64).tolist()
        out[0].extend([i] * len(best))
        out[1].extend(c_ids[at[best]].tolist())
        out[2].extend(chosen)

    for lo in range(0, len(by_length), 128):
        some = by_length[lo : lo + 128]
        # the bucket is sorted by length: nothing shorter than the shortest need can reach a floor
        n = int(np.searchsorted(-c_len, -need[some].min() + 1e-6, side="right")) if len(c_len) else 0
        products = q[some] @ c[:n].T
        for i, row in zip(some, products, strict=True):
            take(i, np.arange(n), row)
    for i in by_coordinate:
        u, at, t = q[i] / q_len[i], np.arange(len(c)), min(1.0, cosine[i])
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            slack = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] ** 2))) + 1e-9
            at = at[np.abs(unit[at, f] - u[f] * t) <= slack] if abs(u[f]) < t else at[unit[at, f] * np.sign(u[f]) >= abs(u[f]) * t - slack]
        take(i, at, c[at] @ q[i])
    return out


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, bucket: int = BUCKET) -> DataFrame:
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    many = -(-n // bucket)
    buckets = written(blocks(rows, many, [F.desc("norm"), "vec_id", "row"]))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = written(blocks(asked, max(1, -(-asked.count() // BLOCK)), ["vec_id", "row"]).select(F.col("bucket").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("width", "wide", "ids", "rows", "norms", "m")]))
    first = buckets.agg(F.min("bucket")).first()[0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, c_ids, numbers = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "ids", "q_rows"))
                most = max(r["width"], r["q_width"])
                q, c = matrix(r["q_m"], r["q_wide"], len(q_ids), r["q_width"], most), matrix(r["m"], r["wide"], len(c_ids), r["width"], most)
                floor = np.frombuffer(r["floor"], "<f8") if r["floor"] else np.full(len(q_ids), -np.inf)
                place, vec, score = answers(q_ids, q, floor, c_ids, c, k)
                yield {"query_row": numbers[place], "query_id": q_ids[place], "vec_id": vec, "score": score}

    out = "query_row long, query_id long, vec_id long, score long"
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    # every block of queries meets the first bucket, that of the longest vectors: one row, of at most `bucket` vectors
    longest = buckets.where(F.col("bucket") == first).join(F.broadcast(queries.agg(F.collect_set("block").alias("all")))).withColumn("block", F.explode("all")).drop("all")
    start = written(mapped(queries.join(longest, "block").withColumn("floor", F.lit(None).cast("binary")), meet, out))
    floors = start.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)

    # a block's floors travel as one row beside it; need: the shortest vector that any of its queries can do with
    spread = mapped(queries.select("block", "q_rows", "q_norms"), _opened, "block int, place int, query_row long, norm double")
    below = spread.join(floors, "query_row", "left").withColumn("least", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
    need = F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).when(F.col("least") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    lists = below.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("f"), F.min(need).alias("need"))
    floor = written(mapped(lists, _packed, "block int, need double, floor binary"))
    # which block meets which bucket is settled before any matrix moves
    ahead = buckets.select("bucket", "longest")
    pairs = floor.select("block", "need", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("bucket")).where(F.col("bucket") != first)
    pairs = written(pairs.join(ahead, "bucket").where(F.col("need") <= F.col("longest") * (1 + 1e-9)).select("block", "bucket"))
    rest = mapped(pairs.join(queries.join(floor.select("block", "floor"), "block"), "block").join(buckets, "bucket"), meet, out)
    best = start.union(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for block, rows, norms in zip(*(b.column(c).to_pylist() for c in ("block", "q_rows", "q_norms")), strict=True):
            numbers = np.frombuffer(rows, "<i8")
            yield {"block": [block] * len(numbers), "place": list(range(len(numbers))), "query_row": numbers, "norm": np.frombuffer(norms, "<f8")}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield {"block": b.column("block"), "need": b.column("need"), "floor": [np.array([x["least"] for x in f], "<f8").tobytes() for f in b.column("f").to_pylist()]}


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
