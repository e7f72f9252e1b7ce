"""Scorers: which table a score is in, and its buckets E (lowest) to A."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

UNSCORED, LETTERS = "UNSCORED", "EDCBA"
#: Edges of the half-open buckets, lowest first. The last one is a little over the domain, to close it.
UNIT_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0001)
TEN_EDGES = (0.0, 2.0, 4.0, 6.0, 8.0, 10.001)


@dataclass(frozen=True)
class Scorer:
    name: str
    edges: tuple[float, ...]

    @property
    def column(self) -> str:
        return f"{self.name}_score"

    def join(self, posts: DataFrame, waifu: DataFrame, aesthetic: DataFrame) -> DataFrame:
        """Left join of the scores; the scorer is picked before the join, so unscored posts survive. Joins once only."""
        if self.column in posts.columns:
            return posts
        side = waifu if self.name == "waifu" else aesthetic.where(F.col("scorer") == self.name)
        return posts.join(side.select(F.col("post_id").alias("id"), F.col("score").alias(self.column)), "id", "left")

    def bucket(self) -> Column:
        """The letter of a score's bucket, by how many inner edges it reaches; scores beyond the ends count there."""
        reached = sum(((F.col(self.column) >= F.lit(e)).cast("int") for e in self.edges[1:-1]), F.lit(1))
        return F.when(F.col(self.column).isNull(), UNSCORED).otherwise(F.element_at(F.array(*map(F.lit, LETTERS)), reached))

    def levels(self, wanted: list[str]) -> Column | None:
        """Posts in any of the buckets; unknown names count for nothing, and None means no predicate is left."""
        c = F.col(self.column)
        inside = {x: (c >= F.lit(lo)) & (c < F.lit(hi)) for x, lo, hi in zip(LETTERS, self.edges, self.edges[1:], strict=False)}
        inside[UNSCORED] = c.isNull()
        parts = [inside[x] for x in wanted if x in inside]
        return reduce(Column.__or__, parts) if parts else None


WAIFU, SILVA, LUNA = Scorer("waifu", TEN_EDGES), Scorer("silva", UNIT_EDGES), Scorer("silva_luna", UNIT_EDGES)
SCORERS = {s.name: s for s in (WAIFU, SILVA, LUNA)}


def in_stars(score: Column) -> Column:
    """A score from 0 to 1 on the 1-5 scale of scores that are given by hand."""
    return F.lit(1.0) + F.lit(4.0) * score
