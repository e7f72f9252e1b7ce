"""Post filters written as text, such as: rating:>=2 score:5 tag:"long hair" ext:png silva:best beach

A term is key:value or key:"some words", with a comparison before the value where the field is a scale. What isn't a
term is search text; so is a term with an unknown key, which is refused as well. One regular expression finds the
terms and a table says how each field reads its value, so this is a helper of one line of text and no query language.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass, replace

from galleon.operators.filters import PostFilter

#: Names of ratings, and of score levels with the bucket each stands for.
RATINGS = {"unrated": 0, "none": 0, "general": 1, "g": 1, "safe": 1, "sensitive": 2, "s": 2, "questionable": 3, "q": 3, "explicit": 4, "e": 4}
LEVELS = {"best": "A", "good": "B", "normal": "C", "bad": "D", "worst": "E"}

TERM = re.compile(r"""(?<!\S)([A-Za-z]+):(>=|<=|>|<|)(?:"([^"]+)"|'([^']+)'|([^\s"'<>=]\S*))(?!\S)""")
HOLDS = {"": operator.eq, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def scale(top: int, names: dict[str, int] = {}):  # noqa: B006
    """Reads a number or a name into all values from 0 to top that compare with it as written."""

    def read(sign: str, value: str) -> list | None:
        if value.lower() in names:
            bound = names[value.lower()]
        elif re.fullmatch(r"-?\d+(\.\d+)?", value):
            bound = float(value)
        else:
            return None
        return [v for v in range(top + 1) if HOLDS[sign](v, bound)]

    return read


def level(sign: str, value: str) -> list | None:
    bucket = LEVELS.get(value.lower())
    return [bucket] if bucket else None


#: Keys, the filter's field, how a value is read; the first key of a field is the one it is written with.
FIELDS = [
    (("rating", "r"), "rating", scale(4, RATINGS)),
    (("score", "sc"), "score", scale(5)),
    (("tag", "t"), "tags", lambda sign, value: [value.strip().replace(" ", "_")]),
    (("ext", "extension"), "extension", lambda sign, value: [value.strip().lower().lstrip(".")]),
    (("waifu",), "waifu_score_levels", level),
    (("silva",), "silva_score_levels", level),
    (("luna",), "silva_luna_score_levels", level),
]
READERS = {key: (field, read) for keys, field, read in FIELDS for key in keys}


@dataclass(frozen=True)
class Search:
    """What a text asks for: a filter, words to look for, and the terms that couldn't be read."""

    post: PostFilter
    words: str = ""
    refused: tuple[str, ...] = ()


def read(text: str) -> Search:
    """Values of repeated terms of a field add up; those of scales come in ascending order."""
    values: dict[str, dict] = {}
    refused: list[str] = []

    def take(m: re.Match) -> str:
        known = READERS.get(m[1].lower())
        found = known[1](m[2], m[3] or m[4] or m[5]) if known else None
        if found is None:
            refused.append(m[0])
            return "" if known else m[0]  # an unknown key may be a word of the text
        values.setdefault(known[0], {}).update(dict.fromkeys(found))
        return ""

    words = " ".join(TERM.sub(take, text).split())
    lists = {field: sorted(v) if field in ("rating", "score") else list(v) for field, v in values.items()}
    return Search(replace(PostFilter(), **lists), words, tuple(refused))


def write(search: Search) -> str:
    """Text that reads as this search again, but for what was refused."""
    spelled = {bucket: name for name, bucket in LEVELS.items()}
    terms = [f"{keys[0]}:{spelled.get(v, v)}" for keys, field, _ in FIELDS for v in getattr(search.post, field)]
    return " ".join([*terms, search.words]).strip()
