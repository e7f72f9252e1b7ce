"""Fill-in-middle: documents are cut into prefix, middle and suffix at line bounds and put together anew.

A byte automaton reads each text once. Its transitions emit marks: a character begins (continuation bytes of UTF-8
don't), a line begins, a sentinel ends. Their counts give a text's lines and characters and tell whether it holds a
sentinel; a second pass over the marks of lines finds where the drawn cuts lie. The same automaton finds the sentinels
of an output when the text is rebuilt.

Null and empty texts: no lines, plain, empty output. A null doc_id is drawn for as empty digits. Repeated rows get equal
rows each. No rows: no rows. Other columns go, whatever their names. Long texts are cut whole; no row meets another,
so no key can be hot. Bytes that are no UTF-8 count as one character each and come out as they went in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from galleon.llm.automata import Automaton, bytes_of, marks
from galleon.llm.base import mapped, table, texts

#: Seed of the draws, per cent of documents that are transformed, per cent of these with the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Marks of transitions.
CHARACTER, LINE, SENTINEL = 1, 2, 4
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"

#: Classes of bytes; `lead` k announces k continuation bytes, `between` stands between texts.
KINDS = ("other", "newline", "open", "letter", "close", "more", "lead1", "lead2", "lead3", "between")
#: States: a line begins with the next byte, inside a line, after <, after < and a letter, continuation bytes to come.
STATES = ("edge", "line", "opened", "named", "more1", "more2", "more3")


def _kind(byte: int) -> str:
    if byte >= 0x80:
        return "more" if byte < 0xC0 else "lead1" if byte < 0xE0 else "lead2" if byte < 0xF0 else "lead3"
    return {10: "newline", 60: "open", 62: "close", 80: "letter", 83: "letter", 77: "letter"}.get(byte, "other")


def _move(state: str, kind: str) -> tuple[str, int]:
    if kind == "between":
        return "edge", 0
    line = LINE if state == "edge" else 0
    if kind == "more":
        return ({"more2": "more1", "more3": "more2"}.get(state, "line"), 0) if state.startswith("more") else ("line", line | CHARACTER)
    if kind == "close" and state == "named":
        return "line", CHARACTER | SENTINEL
    then = {"newline": "edge", "open": "opened", "lead1": "more1", "lead2": "more2", "lead3": "more3"}.get(kind, "line")
    return "named" if kind == "letter" and state == "opened" else then, line | CHARACTER


@cache
def automaton() -> Automaton:
    moves = [[_move(s, k) for k in KINDS] for s in STATES]
    kinds = np.array([KINDS.index(_kind(b)) for b in range(256)], np.uint8)
    return Automaton(kinds, np.array([[STATES.index(s) for s, _ in row] for row in moves]), np.array([[m for _, m in row] for row in moves], np.uint8))


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(ids: list, column: pa.Array, seed: int, rate: int, suffix_first: int) -> dict:
    """Columns of SCHEMA for the texts of a batch."""
    data, first = bytes_of(column)
    found = marks(automaton(), data, first)
    lines, sentinels = np.flatnonzero(found & LINE), np.flatnonzero(found & SENTINEL)
    line, sentinel = np.searchsorted(lines, first), np.searchsorted(sentinels, first)
    before = np.concatenate(([0], np.cumsum(found & CHARACTER, dtype=np.int64)))
    whole = data.tobytes()
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for i, doc_id in enumerate(ids):
        begin, end, n = int(first[i]), int(first[i + 1]), int(line[i + 1] - line[i])
        h1, h2, h3, h4 = drawn(doc_id, seed)
        form = "plain" if begin == end or sentinel[i] < sentinel[i + 1] or h3 % 100 >= rate else "spm" if h4 % 100 < suffix_first else "psm"
        if form == "plain":
            chars, made = (None, None), whole[begin:end]
        else:
            units = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (int(lines[line[i] + k]) if k < n else end for k in units)
            chars = int(before[a] - before[begin]), int(before[b] - before[a])
            prefix, middle, suffix = PREFIX + whole[begin:a], MIDDLE + whole[a:b], SUFFIX + whole[b:end]
            made = (suffix + prefix if form == "spm" else prefix + suffix) + middle
        for name, v in zip(out, (doc_id, n, form, *chars, made), strict=True):
            out[name].append(v)
    return out


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: its lines, the form, characters of prefix and middle (null if plain), and the output."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield cut(b.column("doc_id").to_pylist(), b.column("text"), seed, rate, suffix_first)

    made = mapped(texts(docs), step, SCHEMA)
    return made.withColumn("output", F.col("output").cast("string"))


def rebuilt(forms: list[str], column: pa.Array) -> list[bytes]:
    """The texts of a batch of outputs; an output that doesn't hold its form's sentinels is an error."""
    data, first = bytes_of(column)
    ends = np.flatnonzero(marks(automaton(), data, first) & SENTINEL) + 1
    at, whole, out = np.searchsorted(ends, first, side="right"), data.tobytes(), []
    for i, form in enumerate(forms):
        begin, end = int(first[i]), int(first[i + 1])
        if form == "plain":
            out.append(whole[begin:end])
            continue
        cuts = ends[at[i] : at[i + 1]].tolist()
        names = [whole[c - 3 : c] for c in cuts]
        if names != ([SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]) or cuts[0] != begin + 3:
            raise ValueError(f"an output of the form {form} has the sentinels {names}")
        parts = {name: whole[a:b] for name, a, b in zip(names, cuts, [*[c - 3 for c in cuts[1:]], end], strict=True)}
        out.append(parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX])
    return out


def restored(made: DataFrame) -> DataFrame:
    """The frame (columns form and output among others) with the text that each output was made of."""
    schema = StructType([*made.schema.fields, StructField("restored", BinaryType())])
    names = made.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back = rebuilt(b.column("form").to_pylist(), b.column("output").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, type=pa.binary())], names=[*names, "restored"])

    return made.mapInArrow(step, schema).withColumn("restored", F.col("restored").cast("string"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


_HEX = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
_UPTO = "CASE WHEN {k} = 0 THEN '' WHEN {k} < len(l) THEN array_to_string(l[1:{k}], chr(10)) || chr(10) ELSE t END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
 u AS (SELECT doc_id, t, string_split(t, chr(10)) AS l, {_HEX} FROM d),
 c AS (SELECT *, CASE WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END AS n FROM u),
 f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c),
 g AS (SELECT *, {_UPTO.format(k="k1")} AS p, {_UPTO.format(k="k2")} AS pm FROM f),
 m AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM g)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM m"""
