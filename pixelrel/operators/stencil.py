"""Neighbourhood operators as ROWS windows over reflected axes.

A separable stencil is two windows, one an axis; each partitions by (image, other axis, channel), so work spreads over
the rows and columns of a frame and no frame has to fit in one task. Borders reflect (half-sample symmetric); pixels
near a border give the extra padded rows, all others one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import dims


def pad_axis(pixels: DataFrame, axis: str, before: int, after: int, whole: bool = False) -> DataFrame:
    """Adds i, the padded place on the axis, from -before to size + after - 1; needs height and width columns. Borders
    reflect about the outer edge of the border pixel, or with whole about its centre."""
    n, at = F.col("height" if axis == "y" else "width"), F.col(axis)
    period, edge = (n * 2 - 2, 0) if whole else (n * 2, 1)
    reach = F.ceil(F.lit(max(before, after)) / F.greatest(period, F.lit(1))).cast("int") + 1
    images = F.flatten(F.transform(F.sequence(-reach, reach), lambda k: F.array(at + period * k, period * k - edge - at)))
    images = F.when(period == 0, F.sequence(F.lit(-before), F.lit(after))).otherwise(F.array_distinct(images) if whole else images)
    inner = (at >= before + 1 - edge) & (at < n - after - 1 + edge)
    places = F.when(inner, F.array(at)).otherwise(F.filter(images, lambda i: (i >= -before) & (i < n + after)))
    return pixels.withColumn("i", F.explode(places))


def along(axis: str) -> Window:
    return Window.partitionBy("image_id", "x" if axis == "y" else "y", "c").orderBy("i")


def _inside(axis: str) -> Column:
    return (F.col("i") >= 0) & (F.col("i") < F.col("height" if axis == "y" else "width"))


def along_axis(pixels: DataFrame, axis: str, before: int, after: int, **columns) -> DataFrame:
    """One pass along an axis: each column is made by a function of the ordered window."""
    made = {name: make(along(axis)) for name, make in columns.items()}
    done = pad_axis(pixels, axis, before, after).withColumns(made).where(_inside(axis))
    return done.withColumn(axis, F.col("i")).drop("i")


def _sized(pixels: DataFrame) -> DataFrame:
    return pixels.join(F.broadcast(dims(pixels)), "image_id")


def box(pixels: DataFrame, size: int, *columns: str) -> DataFrame:
    """Means over size x size; an even window covers offsets -size/2 to size/2 - 1."""
    before, after = size // 2, size - 1 - size // 2
    mean = {c: (lambda w, c=c: F.avg(c).over(w.rowsBetween(-before, after))) for c in columns}
    out = _sized(pixels)
    for axis in ("y", "x"):
        out = along_axis(out, axis, before, after, **mean)
    return out


def weighted(pixels: DataFrame, taps: list[float]) -> DataFrame:
    """The same odd filter along y, then along x."""
    r = len(taps) // 2

    def apply(w: Window) -> Column:
        at = lambda d: F.lag("v", -d).over(w) if d else F.col("v")
        return reduce(lambda a, b: a + b, [at(d - r) * t for d, t in enumerate(taps)])

    out = _sized(pixels)
    for axis in ("y", "x"):
        out = along_axis(out, axis, r, r, v=apply)
    return out.select("image_id", "y", "x", "c", "v")


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [t / sum(raw) for t in raw]


def gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    """Blur on y and x only; a sigma of 0 or less changes nothing."""
    return weighted(pixels, gaussian_taps(sigma)) if sigma > 0 else pixels


def local_median(pixels: DataFrame, size: int = 5) -> DataFrame:
    """Adds med, the median over size x size of the same channel (size odd)."""
    r = size // 2
    around = lambda c: lambda w: F.array(*[F.lag(c, -d).over(w) if d else F.col(c) for d in range(-r, r + 1)])
    out = along_axis(_sized(pixels), "y", r, r, column=around("v"))
    out = along_axis(out, "x", r, r, square=around("column"))
    med = F.get(F.array_sort(F.flatten("square")), F.lit(size * size // 2))
    return out.select("image_id", "y", "x", "c", "v", med.alias("med"))


def dilate(flags: DataFrame, rounds: int, size: DataFrame) -> DataFrame:
    """(image_id, y, x, c) set pixels grown by a cross, rounds times: all within that city-block distance, inside the frame."""
    if rounds <= 0:
        return flags.select("image_id", "y", "x", "c").distinct()
    ball = [(a, b) for a in range(-rounds, rounds + 1) for b in range(-rounds, rounds + 1) if abs(a) + abs(b) <= rounds]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ball]))
    moved = flags.select("image_id", "y", "x", "c", step.alias("d")).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "c")
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    return moved.distinct().join(F.broadcast(size), "image_id").where(inside).select("image_id", "y", "x", "c")
