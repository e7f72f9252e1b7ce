"""Score statistics: description, histogram, correlation, joint grid, largest gaps. Results are a few rows each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

PERCENTS = (5, 25, 50, 75, 95)
#: A range with at most so many values is looked at value by value; a larger one is cut into so many parts.
SMALL, PARTS = 100_000, 64


def scored_pairs(lib) -> DataFrame:
    """id, x (waifu) and y (silva) of posts that have both."""
    y = lib.aesthetic.where("scorer = 'silva'").select("post_id", F.col("score").alias("y"))
    return lib.waifu.select("post_id", F.col("score").alias("x")).join(y, "post_id").withColumnRenamed("post_id", "id")


def _cells(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """The column's values with the number of edges at or below them."""
    value = F.col(column).cast("double")
    return df.where(value.isNotNull()).select(value.alias("v"), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)).alias("cell") if edges else F.lit(0).alias("cell"))


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours, without all values in one place.

    The ranks that are asked for are looked for in ranges of values: a pass counts the values of each range, and ranges
    that hold such a rank and over SMALL values are cut at their approximate quantiles, until they are small or hold
    one value. So a pass keeps a few rows per range, and only small ranges are looked at value by value.
    """
    edges: list[float] = []
    while True:
        cells = {r["cell"]: r for r in _cells(df, column, edges).groupBy("cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        n = sum(r["n"] for r in cells.values())
        if not n:
            return [None] * len(shares)
        before, total = {}, 0
        for cell in sorted(cells):
            before[cell], total = total, total + cells[cell]["n"]
        at = [share * (n - 1) for share in shares]
        ranks = {int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at}
        home = {r: max(c for c in before if before[c] <= r) for r in ranks}
        wide = [c for c in set(home.values()) if cells[c]["lo"] < cells[c]["hi"]]
        large = [c for c in wide if cells[c]["n"] > SMALL]
        if not large:
            break
        cuts = _cells(df, column, edges).where(F.col("cell").isin(*large)).groupBy("cell").agg(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 1000).alias("cuts")).collect()
        # a cut at the least value wouldn't part anything: the next double takes its place
        edges = sorted({*edges, *[x if x > cells[r["cell"]]["lo"] else math.nextafter(x, math.inf) for r in cuts for x in r["cuts"]]})
    found = {r: cells[c]["lo"] for r, c in home.items()}
    if wide:
        counts = _cells(df, column, edges).where(F.col("cell").isin(*wide)).groupBy("cell", "v").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("cell").orderBy("v"))
        place = counts.withColumn("upto", upto).withColumn("rank", F.explode(F.array(*[F.lit(r) for r in sorted(ranks)])))
        start = F.create_map(*[F.lit(x) for c in wide for x in (c, before[c])])[F.col("cell")]
        hit = place.where((F.col("rank") >= start + F.col("upto") - F.col("n")) & (F.col("rank") < start + F.col("upto")))
        found |= {r["rank"]: r["v"] for r in hit.select("rank", "v").collect()}
    out = []
    for x in at:
        low, high = int(x), min(int(x) + 1, n - 1)
        out.append(found[low] if low == x else (high - x) * found[low] + (x - low) * found[high])
    return out


def describe(df: DataFrame, column: str) -> DataFrame:
    values = quantiles(df, column, tuple(p / 100 for p in PERCENTS))
    ps = [F.round(F.lit(v).cast("double"), 6).alias(f"p{p:02d}") for p, v in zip(PERCENTS, values, strict=True)]
    r = lambda c: F.round(c, 6)
    return df.agg(F.count(column).alias("n"), r(F.avg(column)).alias("mean"), r(F.stddev_samp(column)).alias("sd"), r(F.min(column)).alias("low"), r(F.max(column)).alias("high")).select("*", *ps)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins, both ends clamped, with each bin's share in per cent."""
    place = F.least(F.greatest(F.floor((F.col(column) - F.lit(low)) / F.lit((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.corr("x", "y"), 6).alias("r"))


def average_rank(pairs: DataFrame, column: str, cells: int = 64) -> DataFrame:
    """Value and average rank, from counts per value.

    The different values are dealt into cells at their quantiles, in order: a value's rank is what the cells before
    hold, plus its place in its own cell. So no cell has much more than its share of the values, however they lie, and
    no window spans more than one cell, or the cells' totals (cells + 1 rows).
    """
    counts = pairs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    splits = counts.agg(F.percentile_approx(column, [k / cells for k in range(1, cells)], 1000).alias("splits"))
    cell = F.size(F.filter("splits", lambda s: s < F.col(column)))
    placed = counts.join(F.broadcast(splits)).select(column, "n", cell.alias("cell"))
    totals = placed.groupBy("cell").agg(F.sum("n").alias("total"))
    before = totals.select("cell", (F.sum("total").over(Window.orderBy("cell")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy(column)) - F.col("n")
    return placed.join(F.broadcast(before), "cell").select(column, (F.col("before") + inside + (F.col("n") + 1) / 2.0).alias(f"rank_{column}"))


def spearman(pairs: DataFrame) -> DataFrame:
    ranked = pairs.join(average_rank(pairs, "x"), "x").join(average_rank(pairs, "y"), "y")
    return ranked.agg(F.round(F.corr("rank_x", "rank_y"), 6).alias("rho"))


def joint_grid(pairs: DataFrame, cells: int = 5) -> DataFrame:
    """Counts on a grid between the 5th and the 95th percentile of either score; the outer cells are open."""
    edges = {c: quantiles(pairs, c, (0.05, 0.95)) for c in "xy"}

    def at(c: str):
        low, high = (F.lit(v).cast("double") for v in edges[c])
        return F.least(F.greatest(F.floor((F.col(c) - low) / ((high - low) / cells)), F.lit(0)), F.lit(cells - 1)).cast("bigint").alias(f"{c}_bin")

    return pairs.select(at("x"), at("y")).groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def z_gaps(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k posts whose standardised scores differ most, either way."""
    stats = pairs.agg(F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"), F.avg("y").alias("my"), F.stddev_samp("y").alias("sy"))
    gap = pairs.join(F.broadcast(stats)).select("id", ((F.col("x") - F.col("mx")) / F.col("sx") - (F.col("y") - F.col("my")) / F.col("sy")).alias("gap"))
    top = gap.orderBy(F.desc("gap"), "id").limit(k).withColumn("side", F.lit("high"))
    low = gap.orderBy("gap", "id").limit(k).withColumn("side", F.lit("low"))
    return top.union(low).select("side", "id", F.round("gap", 6).alias("gap"))
