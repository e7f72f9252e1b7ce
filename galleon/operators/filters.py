"""The post filter: a value object that becomes one plan of joins and predicates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from galleon.functions.columns import under
from galleon.functions.scoring import LUNA, SILVA, WAIFU

ORDERABLE = frozenset({"id", "score", "rating", "created_at", "published_at", "published_key", "file_name", "last_accessed_at", "updated_at", "waifu_score", "silva_score", "silva_luna_score", "discrepancy"})
UPDATABLE = frozenset({"score", "rating", "caption", "source", "description", "meta"})
BULK_UPDATABLE = frozenset({"score", "rating"})
GROUPABLE = frozenset({"rating", "score", "extension"})


@dataclass(frozen=True)
class PostFilter:
    rating: list[int] = field(default_factory=list)
    score: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    extension: list[str] = field(default_factory=list)
    folder: str | None = None
    lab: tuple[float, float, float] | None = None
    waifu_score_range: tuple[float, float] | None = None
    waifu_score_levels: list[str] = field(default_factory=list)
    silva_score_levels: list[str] = field(default_factory=list)
    silva_luna_score_levels: list[str] = field(default_factory=list)
    only_canonical: bool = True

    def without(self, name: str) -> PostFilter:
        """The filter with one field cleared: a facet doesn't narrow itself."""
        return replace(self, **{name: type(self).__dataclass_fields__[name].default_factory() if name in ("rating", "score", "tags", "extension") or name.endswith("_levels") else None})

    def active(self) -> bool:
        """Whether anything but only_canonical narrows the posts."""
        return bool(self.rating or self.score or self.tags or self.extension or (self.folder and self.folder != ".") or self.lab or self.waifu_score_range or self.waifu_score_levels or self.silva_score_levels or self.silva_luna_score_levels)


def checked(column: str, allowed: frozenset) -> str:
    if column not in allowed:
        raise ValueError(f"{column!r} isn't one of {sorted(allowed)}")
    return column


def apply_filter(lib, f: PostFilter) -> DataFrame:
    """Posts that pass. Score joins are made only where a score is asked for; `lab` orders and doesn't narrow."""
    posts = lib.posts
    if f.only_canonical:
        posts = posts.where(F.col("canonical_post_id").isNull())
    for name in ("rating", "score", "extension"):
        if getattr(f, name):
            posts = posts.where(F.col(name).isin(*getattr(f, name)))
    if f.folder and f.folder != ".":
        posts = posts.where(under(f.folder))
    if f.tags:  # one pass over the links, however many tags
        links = lib.post_has_tag.where(F.col("tag_name").isin(*f.tags)).groupBy(F.col("post_id").alias("id"))
        posts = posts.join(links.agg(F.countDistinct("tag_name").alias("n")).where(F.col("n") == len(set(f.tags))), "id", "left_semi")
    if f.waifu_score_range:
        posts = WAIFU.join(posts, lib.waifu, lib.aesthetic).where(F.col("waifu_score").between(*map(float, f.waifu_score_range)))
    for scorer, levels in ((WAIFU, f.waifu_score_levels), (SILVA, f.silva_score_levels), (LUNA, f.silva_luna_score_levels)):
        if levels:
            posts = scorer.join(posts, lib.waifu, lib.aesthetic)
            if (found := scorer.levels(levels)) is not None:
                posts = posts.where(found)
    return posts
