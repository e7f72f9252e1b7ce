"""Phrase collocations: words of a language that stand together more often than their parts explain.

Equal pieces of text are counted first, so a line that repeats is split once. Each level then explodes its n-grams into
rows, which a hash aggregation counts per language; levels follow one another, so the disks hold one level's shuffle at
a time. Counts below `least` go at once: a part occurs at least as often as its phrase, so no candidate misses one.
Candidates join the counts of what stands before and after each cut and score in decimals; an anti-join with their
extensions by one word drops those that a longer phrase explains (what a phrase longer by two words explains, its part
longer by one word does too). Windows rank within hashed cells, then fewer, then within the language, so no task sorts
more than a cell.

Frequent parts: those with a share of 1 / HOT of all word occurrences are at most HOT words and as many phrases of each
length, which are broadcast; any other part has under a share of 1 / (HOT * least) of occurrences as candidates.

Null texts are empty and have no words; a null language is UND, together with rows that say so. Repeated rows count each.
doc_id isn't read. Empty tables give no rows. Other columns go, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from galleon.llm.base import table, written

#: Longest phrase, least count of a candidate, rows of a language, per cent of a phrase's occurrences
#: inside a longer one that drop it, scale of the score, name of a missing language, characters that end a piece.
MAX_N, LEAST, TOP, COVER, SCALE, UND, ENDS = 3, 10, 2000, 50, 1_000_000, "und", r"[.,;:!?\x0A-\x0D]"
#: Parts with at least this share (one in HOT) of all word occurrences are joined by broadcast.
HOT = 4096
#: Cells of the last rankings but one and two.
CELLS = (16, 2)


def lowered(text: Column) -> Column:
    """A-Z in lower case; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def pieces(docs: DataFrame) -> DataFrame:
    """lang, words and how often the piece occurs; each different piece once."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit(UND)).alias("lang"), F.explode(F.split("text", ENDS)).alias("piece"))
    trimmed = rows.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''").select("lang", lowered(F.col("piece")).alias("piece"))
    return trimmed.groupBy("lang", "piece").agg(F.count("*").alias("times")).select("lang", F.split("piece", "[ \t]+").alias("words"), "times")


def grams(found: DataFrame, n: int, least: int) -> DataFrame:
    """lang, phrase and f of every run of n words that occurs at least so often."""
    shifted = F.arrays_zip(*[F.slice("words", k + 1, F.size("words") - (n - 1)).alias(f"w{k}") for k in range(n)])
    rows = found.where(F.size("words") >= n).select("lang", "times", F.inline(shifted))
    phrase = F.concat_ws(" ", *rows.columns[2:])
    return rows.select("lang", phrase.alias("phrase"), "times").groupBy("lang", "phrase").agg(F.sum("times").alias("f")).where(F.col("f") >= least)


def with_count(rows: DataFrame, part: str, counts: DataFrame, hot: DataFrame, name: str) -> DataFrame:
    """The rows with the count of their part: frequent parts by broadcast, the others by a join."""
    tried = rows.join(F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))), ["lang", part], "left")
    rest = tried.where(F.col(name).isNull()).drop(name)
    return tried.where(F.col(name).isNotNull()).unionByName(rest.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in decimals of 38 digits."""
    return F.expr(f"(CAST({a} AS DECIMAL(19, 0)) * {a} * {SCALE}) DIV (CAST({left} AS DECIMAL(19, 0)) * {right})")


def leading(rows: DataFrame, top: int, cells: int) -> DataFrame:
    """Each language's first rows with their rank, by score, then count, then phrase."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for among in (cells, *CELLS, 1):
        of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(among))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(of).cast("long")).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's leading phrases of 2 to max_n words."""
    spark = docs.sparkSession
    found = written(pieces(docs))
    total = found.groupBy("lang").agg(F.sum(F.col("times") * F.size("words")).alias("n"))
    levels = [written(grams(found, n, least)) for n in range(1, max_n + 1)]
    every = total.agg(F.sum("n")).first()[0] or 0
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    counts = union(levels[:-1])
    hot = counts.where(F.col("f") * HOT >= every)
    candidates = union([level.withColumn("size", F.lit(n)) for n, level in enumerate(levels, 1) if n > 1])

    words = F.split("phrase", " ")
    part = lambda begin, length: F.array_join(F.slice(words, begin, length), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, F.col("size")).alias("rest"))))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    both = with_count(with_count(cuts, "head", counts, hot, "l"), "rest", counts, hot, "r")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("c"))
    scored = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    longer = candidates.where("size > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    same = (F.col("s.lang") == F.col("i.lang")) & (F.col("s.phrase") == F.col("i.phrase")) & (100 * F.col("i.most") >= COVER * F.col("s.a"))
    kept = scored.alias("s").join(inside.alias("i"), same, "left_anti")
    ranked = leading(kept, top, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p WHERE len(w) >= {n})" for n in range(1, MAX_N + 1))
_INNER = " UNION ALL ".join(f"SELECT lang, f, unnest([array_to_string(w[i:i + {m - 1}], ' ') for i in range(1, {n - m + 2})]) AS phrase FROM c WHERE size = {n}" for n in range(3, MAX_N + 1) for m in range(2, n))
ORACLE = rf"""
WITH p AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(x, '[ \t]+'), lambda y: y <> '') AS w FROM (SELECT coalesce(lang, '{UND}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{ENDS}')) AS x FROM documents)),
 t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
 g AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY 1, 2, 3),
 c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= {LEAST}),
 k AS MATERIALIZED (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
 s AS (SELECT k.lang, k.phrase, k.f AS a, a.f AS l, b.f AS r, k.k AS k, CAST((CAST(k.f AS HUGEINT) * k.f * {SCALE}) // (CAST(a.f AS HUGEINT) * b.f) AS BIGINT) AS score FROM k JOIN g a ON a.lang = k.lang AND a.phrase = k.head JOIN g b ON b.lang = k.lang AND b.phrase = k.rest),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 o AS ({_INNER}),
 x AS (SELECT DISTINCT c.lang AS lang, c.phrase AS phrase FROM c JOIN o ON o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.f >= {COVER} * c.f)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT m.lang AS lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM m ANTI JOIN x ON x.lang = m.lang AND x.phrase = m.phrase) JOIN t USING (lang) WHERE rank <= {TOP}"""
