"""Secret scans: all rules compiled into one minimal automaton that reads every byte once.

The rules' regexes become one deterministic automaton by subset construction and minimisation, over mirrored regexes:
it reads texts backward, and its transitions tell at each byte which rules have a match that begins there. Only where
one begins, a rule's own automaton walks forward to the longest match. Matches of a rule are leftmost and don't overlap;
those too short are dropped, and what they covered isn't searched again.

Null and empty texts hold nothing. Repeated rows, also those that share a doc_id or have none, are each scanned. No
rows: no rows. Other columns go, whatever their names. Texts of any length are scanned whole; no row meets another, so
no key can be hot. Places are counted in code points.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleon.llm.automata import Automaton, bytes_of, compiled, marks, mirrored, parsed
from galleon.llm.base import mapped, table, texts


class Rule(NamedTuple):
    """kind, regex, least length of the match, or of its tail: what follows where a match could first have ended."""

    kind: str
    regex: str
    least: int = 0
    tail: int = 0
    fold: bool = False


#: The base rules. A run of hexadecimal digits shorter than 16 can hold no longer one.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", tail=12, fold=True),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Rules of published token formats beside them.
MORE = (
    Rule("bearer", r"bearer\x20+([A-Za-z0-9+/_.~=-]+)", tail=20, fold=True),
    Rule("forge", "gh[opsur]_([A-Za-z0-9]+)", tail=30),
    Rule("chat", "xox[abeprs]-([A-Za-z0-9-]+)", tail=16),
    Rule("maps", "AIza([A-Za-z0-9_-]+)", tail=30),
    Rule("payment", "[rs]k_(live|test)_([A-Za-z0-9]+)", tail=16),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", least=40),
    Rule("login", r"://[A-Za-z0-9_.+-]+:[A-Za-z0-9_.!*+-]+@"),
    Rule("privatekey", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
SCHEMA = "doc_id long, kinds array<string>, starts array<long>, ends array<long>, secrets array<string>"


class Scanner(NamedTuple):
    rules: tuple[Rule, ...]
    backward: Automaton
    forward: list[Automaton]


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Some tens of kilobytes of transition arrays; made once, on the driver."""
    trees = [parsed(r.regex, r.fold) for r in rules]
    return Scanner(rules, compiled([mirrored(t) for t in trees], anywhere=True), [compiled([t], anywhere=False) for t in trees])


def walker(automaton: Automaton):
    """A function that tells where the shortest and the longest match that begin at a place end."""
    stays = (automaton.step[:, :-1] == np.arange(len(automaton.step))[:, None]).all(1) & ~automaton.emit[:, :-1].any(1)
    dead = int(stays.argmax()) if stays.any() else -1
    kinds, step, emit = automaton.kinds.tolist(), automaton.step.tolist(), automaton.emit.tolist()

    def longest(data: bytes, at: int, end: int) -> tuple[int, int]:
        state, short, long = 0, -1, -1
        while at < end and state != dead:
            kind = kinds[data[at]]
            at += 1
            if emit[state][kind]:
                short, long = at if short < 0 else short, at
            state = step[state][kind]
        return short, long

    return longest


def found(scan: Scanner, column: pa.Array) -> list[list[tuple[str, int, int, bytes]]]:
    """(kind, start, end, secret) of each text of a batch, by start, then in the rules' order."""
    data, first = bytes_of(column)
    begins = marks(scan.backward, data, first, backward=True)
    whole, hits = data.tobytes(), []
    for i, rule in enumerate(scan.rules):
        starts = np.flatnonzero(begins & np.uint32(1 << i))
        ends = first[np.searchsorted(first, starts, side="right")].tolist()
        starts, k, longest = starts.tolist(), 0, walker(scan.forward[i])
        while k < len(starts):
            short, long = longest(whole, starts[k], ends[k])
            if long - starts[k] >= rule.least and long - short + 1 >= rule.tail:
                hits.append((starts[k], i, long))
            k = bisect_left(starts, long, k + 1)
    out: list[list] = [[] for _ in range(len(first) - 1)]
    if not hits:
        return out
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    for start, i, end in sorted(hits):
        doc = int(np.searchsorted(first, start, side="right")) - 1
        zero = before[first[doc]]
        out[doc].append((scan.rules[i].kind, int(before[start] - zero), int(before[end] - zero), whole[start:end]))
    return out


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: kind, start, end and text of every secret, as arrays of equal length."""
    scan = scanner(rules)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = found(scan, b.column("text"))
            part = lambda k: [[h[k] for h in r] for r in rows]  # noqa: E731, B023
            yield {"doc_id": b.column("doc_id"), "kinds": part(0), "starts": part(1), "ends": part(2), "secrets": part(3)}

    return mapped(texts(docs), step, SCHEMA)


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    hits = secret_scan(table(spark, sf_dir, "documents")).withColumn("h", F.arrays_zip("kinds", "starts", "ends"))
    joined = lambda h: F.array_join(F.transform(h, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")
    own = F.filter("h", lambda x: x["kinds"].isin(*[r.kind for r in BASE]))
    number = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return hits.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("h")).alias("spans"))


def _sql(i: int, rule: Rule) -> str:
    regex = rule.regex.replace("'", "''").replace("\\x20", " ")
    flags = ", 'i'" if rule.fold else ""
    tail = f"length(regexp_extract(m[i], '{regex}', {rule.regex.count('(')}{flags})) >= {rule.tail}" if rule.tail else "true"
    return (
        f"SELECT r, '{rule.kind}' AS kind, {i} AS k, start, start + len(m[i]) AS stop FROM (SELECT r, m, i, "
        f"CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start FROM "
        f"(SELECT r, regexp_extract_all(t, '{regex}', 0{flags}) AS m, string_split_regex(t, '{regex}'{flags}) AS g, unnest(range(1, len(m) + 1)) AS i FROM d)) WHERE len(m[i]) >= {rule.least} AND {tail}"
    )


_JOINED = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k){}, '')"
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(_sql(i, r) for i, r in enumerate(RULES)) + ") "
    "SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE) + f", sha256({_JOINED.format(f' FILTER (k < {len(BASE)})')}) AS base_sha256, {_JOINED.format(' FILTER (kind IS NOT NULL)')} AS spans "
    "FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"
)
