"""Scalar functions as Columns: text, colours, vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Extensions of images, as the pending queries (narrow) and the commands (wide) know them.
IMAGE_NARROW = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
IMAGE_WIDE = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif", "avif", "heic")
SEED_MODULUS = 2147483647


def stem(name: str | Column) -> Column:
    """A file name up to its last dot, unless that is its first character."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.rlike(r"(?s)^.+\."), F.regexp_extract(c, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(c)


def extension(name: str | Column) -> Column:
    """What follows a file name's last dot; empty for none, or if the dot is the first character."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"(?s)^.+\.([^.]*)$", 1)


def is_image(ext: str = "extension") -> Column:
    return F.lower(F.col(ext)).isin(*IMAGE_NARROW)


def is_image_path(path: Column) -> Column:
    return path.rlike(rf"(?i)\.({'|'.join(IMAGE_WIDE)})$")


def full_path() -> Column:
    return F.concat("file_path", F.lit("/"), "file_name", F.lit("."), "extension")


def aspect_ratio() -> Column:
    """Width by height; null where the height is 0."""
    return F.when(F.col("height") != 0, F.col("width") * F.lit(1.0) / F.col("height"))


def contains_ci(text: Column, part: str) -> Column:
    """ASCII case-insensitive substring; %, _ and backslash have no special meaning."""
    return F.lower(text).contains(part.lower())


def under(folder: str, path: str = "file_path") -> Column:
    """The folder itself or anything below it; '0' follows '/', so a range does it, and no sibling slips in."""
    c = F.col(path)
    return (c == folder) | ((c >= f"{folder}/") & (c < f"{folder}0"))


def safe_dir(name: Column) -> Column:
    """A name that every file system takes: reserved characters become _, dots and spaces at the end go, empty is _."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    return F.when(clean == "", "_").otherwise(clean)


def tag_words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def iso_text(ts: Column) -> Column:
    """Timestamp text with its first space as a T."""
    return F.regexp_replace(ts, r"^([^ ]*) ", r"$1T")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def hex_colour(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(rgb)), 6, "0"))


def srgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIE Lab (D65) of sRGB channels 0 to 255, as an array of three."""

    def linear(c: Column) -> Column:
        v = c / F.lit(255.0)
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92)

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(t * 7.787 + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = f((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.95047)
    y = f(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)
    z = f((lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883)
    return F.array(y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector by its length; null for the zero vector. The length is an argument, or each component would find it anew."""
    n = norm(a)
    return F.when(n > 0, F.transform(F.array(n), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0])


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def match_probability(cos: Column, scale: float, bias: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(cos * F.lit(scale) + F.lit(bias))))


def seed_of(seed: int | None) -> int:
    return ((seed or 1) % SEED_MODULUS) or 1


def shuffle_key(seed: int | None, column: str = "id") -> Column:
    """A key of its own for each id below the modulus: pages of a shuffled order don't overlap."""
    return F.col(column).cast("bigint") * F.lit(seed_of(seed)).cast("bigint") % F.lit(SEED_MODULUS)
