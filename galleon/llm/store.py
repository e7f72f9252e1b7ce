"""Token ids in a content-addressed store.

Every document's ids, with the end id 1, are cut into chunks by a rolling hash of WINDOW ids, so that equal passages
give equal chunks wherever they stand. The store has two tables in the shared folder. `objects` holds each distinct
chunk once under its BLAKE2b digest (16-bit little-endian ids), in buckets by digest. `manifest` holds, in ascending
doc_id order, for each document its recipe (the digests in order), its number of ids, its start among all ids and the
Merkle root over the recipe. Reading back checks every recipe against its root and every chunk it uses against its
name, fetches the chunks of each recipe and puts the document's ids together again.

Null and empty texts are the end id alone. Rows that share a doc_id, or have none, are stored each (null ids first).
Texts of any length give chunks of at most LONGEST ids. Copies, however many, share their chunks: a chunk's bytes
leave a task once when they are stored, and uses of a chunk are asked for once by every USES of them, so a chunk that
a third of all documents share is spread over many rows. The documents must come from a table: their rows are numbered
once, while they are encoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from galleon.llm.base import mapped, shared, stored, table
from galleon.llm.tokens import encoder, vocabulary

END, WINDOW, SHORTEST, MASK, LONGEST = 1, 8, 64, 255, 2048
DIGEST = 16
#: Uses of chunks that a task puts together before it asks for the chunks.
USES = 1 << 16
STAGED = "kind string, name binary, data binary, doc_id long, row long, n_tokens long, recipe binary, root binary"
MANIFEST = "part int, doc_id long, row long, local long, n_tokens long, recipe binary, root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the digests: pairs are hashed together, a last one without partner goes up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else b""


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after a window of WINDOW ids whose rolling hash says that a chunk may end there, ascending."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    h, k = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while k < WINDOW:  # the hash of 2k ids from those of k
        h = h[:-k] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) % 2**64 | 1) + h[k:]
        k *= 2
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + WINDOW


def cuts(lo: int, hi: int, found: list[int]) -> list[int]:
    """Ends of the chunks of the ids from lo to hi, given its marks: at least SHORTEST and at most LONGEST ids apart."""
    out, at = [], lo
    for end in (*found, hi):
        while end - at > LONGEST:
            at += LONGEST
            out.append(at)
        if end - at >= SHORTEST or end == hi > at:
            out.append(end)
            at = end
    return out


def with_ends(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids with the end id after each, and where each document ends."""
    ends = np.cumsum(count + 1)
    out = np.full(len(ids) + len(count), END, ids.dtype)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def chunked(docs: DataFrame, path: str) -> DataFrame:
    """kind=chunk: a row per chunk that is new in its task; kind=doc: a row per document with its recipe and root."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, sent = encoder(path, True), set()
        for b in batches:
            ids, ends = with_ends(*enc.encode(b.column("text").to_pylist()))
            data, at = ids.astype("<u2", copy=False).tobytes(), marks(ids)
            # windows that reach into the next document don't count
            doc = np.searchsorted(ends, at - WINDOW, side="right")
            at = at[at <= ends[doc]] if len(at) else at
            split = np.split(at, np.searchsorted(at, ends[:-1], side="right")) if len(ends) else []
            names, chunks, recipes, roots, start = [], [], [], [], 0
            for end, found in zip(ends.tolist(), split, strict=True):
                recipe = []
                for stop in cuts(start, end, found.tolist()):
                    chunk = data[2 * start : 2 * stop]
                    name = digest(chunk)
                    recipe.append(name)
                    if name not in sent:
                        sent.add(name)
                        names.append(name)
                        chunks.append(chunk)
                    start = stop
                recipes.append(b"".join(recipe))
                roots.append(merkle(recipe))
            k, n = [None] * len(names), [None] * b.num_rows
            yield {"kind": ["chunk"] * len(k), "name": names, "data": chunks} | dict.fromkeys(("doc_id", "row", "n_tokens", "recipe", "root"), k)
            sizes = np.diff(ends, prepend=0)
            yield {"kind": ["doc"] * len(n), "name": n, "data": n, "doc_id": b.column("doc_id"), "row": b.column("row"), "n_tokens": sizes, "recipe": recipes, "root": roots}

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return mapped(rows, step, STAGED)


def write_store(docs: DataFrame, path: str | None = None, folder: str | None = None) -> str:
    """Writes the store of all documents and returns its folder."""
    spark = docs.sparkSession
    folder = folder or shared(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one digest are in one partition: the first one of each is kept, and so is every document."""
        kept: set = set()
        for b in batches:
            keep = []
            for name in b.column("name").to_pylist():
                keep.append(name is None or name not in kept)
                kept.add(name)
            yield b.filter(pa.array(keep))

    # chunks meet by their names, at most one row from each task; documents are spread by their numbers
    deal = F.coalesce("name", F.encode(F.col("row").cast("string"), "utf-8"))
    staged = chunked(docs, path or vocabulary("word_bpe_49k.json")).withColumn("deal", deal).repartition(parts, "deal").drop("deal")
    stored(staged.mapInArrow(once, STAGED), f"{folder}/staged", "kind", buckets=(parts, "name"))
    spark.createDataFrame([(parts,)], "buckets int").coalesce(1).write.parquet(f"{folder}/shape")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.asarray(b.column("n_tokens"))
            ends = at + np.cumsum(n)
            yield {k: b.column(k) for k in ("doc_id", "row", "n_tokens", "recipe", "root")} | {"part": [part] * len(n), "local": ends - n}
            at = int(ends[-1]) if len(ends) else at

    found = spark.read.schema(STAGED).parquet(f"{folder}/staged").where("kind = 'doc'")
    ordered = found.select("doc_id", "row", "n_tokens", "recipe", "root").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    stored(mapped(ordered, numbered, MANIFEST), f"{folder}/manifest")
    return folder


def objects(spark, folder: str) -> DataFrame:
    """(name, data) of every chunk, known to Spark as dealt out by name: a join on it moves the other side only."""
    n = spark.read.parquet(f"{folder}/shape").first()[0]
    name = f"chunks_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (name BINARY, data BINARY) USING parquet CLUSTERED BY (name) INTO {n} BUCKETS LOCATION '{folder}/staged/kind=chunk'")
    return spark.table(name)


def uses(manifest: DataFrame) -> DataFrame:
    """(name, rows, seqs): which chunks the recipes name and where; recipes that don't fit their root are an error."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        asked: dict[bytes, tuple[list, list]] = {}
        n = 0

        def told() -> dict:
            return {"name": list(asked), "rows": [r for r, _ in asked.values()], "seqs": [s for _, s in asked.values()]}

        for b in batches:
            for row, recipe, root in zip(*(b.column(k).to_pylist() for k in ("row", "recipe", "root")), strict=True):
                names = [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]
                if merkle(names) != root:
                    raise ValueError("a recipe doesn't fit its Merkle root")
                for seq, name in enumerate(names):
                    rows, seqs = asked.setdefault(name, ([], []))
                    rows.append(row)
                    seqs.append(seq)
                n += len(names)
                if n > USES:
                    yield told()
                    asked, n = {}, 0
        yield told()

    return mapped(manifest.select("row", "recipe", "root"), step, "name binary, rows array<long>, seqs array<int>")


def rebuilt(spark, folder: str, of: Callable[[bytes], dict], schema: str) -> DataFrame:
    """row, n (number of ids) and what `of` makes of each document's ids (16-bit little-endian), put together again."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # a left join: a chunk that is missing shows as a null, not as a shorter document
    found = uses(manifest).hint("merge").join(objects(spark, folder), "name", "left")
    each = found.select(F.explode(F.arrays_zip("rows", "seqs")).alias("u"), "name", "data").select("u.rows", "u.seqs", "name", "data")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, held = None, []
        names = [x.split()[0] for x in schema.split(", ")]

        def closed(out: dict) -> None:
            if last is not None:
                ids = b"".join(held)
                for k, v in ({"row": last, "n": len(ids) // 2} | of(ids)).items():
                    out[k].append(v)

        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n", *names)}
            for row, name, data in zip(*(b.column(k).to_pylist() for k in ("rows", "name", "data")), strict=True):
                if data is None:
                    raise ValueError("a chunk is missing")
                if digest(data) != name:
                    raise ValueError("a chunk isn't what its name says")
                if row != last:
                    closed(out)
                    last, held = row, []
                held.append(data)
            yield out
        out = {k: [] for k in ("row", "n", *names)}
        closed(out)
        yield out

    dealt = each.repartition("rows").sortWithinPartitions("rows", "seqs")
    return mapped(dealt, whole, f"row long, n long, {schema}")


def with_starts(spark, folder: str, found: DataFrame) -> DataFrame:
    """The documents' rows with doc_id, start and n_tokens; a number of ids that isn't the manifest's is an error."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per range partition: their totals give every partition's start
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0  # an empty store has no totals
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    checked = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document has lost ids")).cast("long"))
    rows = manifest.select("part", "doc_id", "row", "local", "n_tokens").join(base, "part").join(found, "row", "left")
    return rows.select("doc_id", (F.col("base") + F.col("local")).alias("start"), checked.alias("n_tokens"), *[c for c in found.columns if c not in ("row", "n")])


def documents(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (16-bit little-endian) of every document of the store."""
    return with_starts(spark, folder, rebuilt(spark, folder, lambda ids: {"ids": ids}, "ids binary"))


def wide_crc(ids: bytes) -> dict:
    return {"ids_crc32": zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())}


def read_store(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its rebuilt ids as 32-bit numbers."""
    return with_starts(spark, folder, rebuilt(spark, folder, wide_crc, "ids_crc32 long"))


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    return read_store(spark, write_store(table(spark, sf_dir, "documents")))
