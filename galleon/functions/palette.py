"""Colour palettes of many pictures at once: boxes of a 5-bit colour histogram, split round by round.

Pixels are counted per picture and cell of 32 x 32 x 32 colours. Each round splits one box of every picture, along its
longest side and near the median: first the box with most pixels, then the one with the largest product of pixels and
volume. Boxes are as tight as the cells in them. A round is made of windows over a picture's counted cells, 32,768 at
most, so after the counting nothing is shuffled but what windows of one picture need.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits that are left out, least alpha, brightest channel of a colour that isn't white, share of colours
#: that are found by population alone.
SHIFT, ALPHA, WHITE, BY_POPULATION = 3, 125, 250, 0.75
AXES = ("r", "g", "b")


def histogram(pixels: DataFrame) -> DataFrame:
    """picture, r, g, b (of 32) and n, of pixels (picture, r, g, b, a) that are mostly opaque and not white."""
    dull = F.least(*AXES) <= WHITE
    cells = [F.shiftright(F.col(c).cast("int"), SHIFT).alias(c) for c in AXES]
    return pixels.where((F.col("a") >= ALPHA) & dull).groupBy("picture", *cells).agg(F.count("*").alias("n"))


def split(cells: DataFrame, by_volume: bool, number: int) -> DataFrame:
    """One more box, `number`, for each picture that has one to split; cells carry their box."""
    box, picture = Window.partitionBy("picture", "box"), Window.partitionBy("picture")
    stats = {"_n": F.sum("n").over(box)} | {f"_{c}{k}": f(c).over(box) for c in AXES for k, f in ((1, F.min), (2, F.max))}
    cells = cells.withColumns(stats)
    side = {c: F.col(f"_{c}2") - F.col(f"_{c}1") + 1 for c in AXES}
    volume = side["r"] * side["g"] * side["b"]
    weight = F.when(volume > 1, F.col("_n") * volume if by_volume else F.col("_n")).otherwise(F.lit(-1))
    longest = F.greatest(*side.values())

    def of(k: str) -> Column:
        """The longest side's value: the cell's own coordinate, or the box's first or last."""
        name = lambda c: F.col(f"_{c}{k}" if k else c)
        return F.when(side["r"] == longest, name("r")).when(side["g"] == longest, name("g")).otherwise(name("b"))

    cells = cells.withColumns({"_w": weight, "_at": of(""), "_lo": of("1"), "_hi": of("2")})
    cells = cells.withColumns({"_top": F.max(F.struct("_w", (-F.col("box")).alias("_first"))).over(picture), "_sum": F.sum("n").over(box.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))})
    cells = cells.withColumn("_mid", F.min(F.when(2 * F.col("_sum") > F.col("_n"), F.col("_at"))).over(box))
    left, right = F.col("_mid") - F.col("_lo"), F.col("_hi") - F.col("_mid")
    last = F.when(left <= right, F.least(F.col("_hi") - 1, F.floor(F.col("_mid") + right / 2))).otherwise(F.greatest(F.col("_lo"), F.floor(F.col("_mid") - 1 - left / 2)))
    chosen = (F.col("_top")["_w"] > 0) & (F.col("_top")["_first"] == -F.col("box")) & (F.col("_at") > last)
    return cells.withColumn("box", F.when(chosen, F.lit(number)).otherwise(F.col("box"))).select("picture", *AXES, "n", "box")


def palettes(pixels: DataFrame, colours: int = 5, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """picture, position (from 0, most pixels first), colour (packed RGB) and n of up to `colours` boxes of each picture.

    keep() materialises the cells every few rounds, so that the plan stays short.
    """
    cells = histogram(pixels).withColumn("box", F.lit(0))
    first = math.ceil(BY_POPULATION * colours)
    for k in range(1, colours):
        cells = split(cells, k >= first, k)
        if keep and k % 3 == 0:
            cells = keep(cells)
    centre = lambda c: F.floor(F.sum(F.col("n") * (2 * F.col(c) + 1) * (1 << SHIFT)) / (2 * F.sum("n"))).cast("int")
    boxes = cells.groupBy("picture", "box").agg((F.shiftleft(centre("r"), 16) + F.shiftleft(centre("g"), 8) + centre("b")).alias("colour"), F.sum("n").alias("n"))
    order = Window.partitionBy("picture").orderBy(F.desc("n"), "colour")
    return boxes.select("picture", (F.row_number().over(order) - 1).alias("position"), "colour", "n")
