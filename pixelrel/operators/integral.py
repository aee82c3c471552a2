"""Prefix sums and sums over p x p patches by their top-left corner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import dims

BLACK, VARIANCE = 0.05, 1e-5


def _axes():
    return Window.partitionBy("image_id", "x").orderBy("y"), Window.partitionBy("image_id", "y").orderBy("x")


def prefix_sum(grid: DataFrame, value: str) -> DataFrame:
    """Adds sat: the sum of value over all cells up and left of a cell, itself included. One row a (image_id, y, x)."""
    down, right = (w.rowsBetween(Window.unboundedPreceding, 0) for w in _axes())
    return grid.withColumn("_d", F.sum(value).over(down)).withColumn("sat", F.sum("_d").over(right)).drop("_d")


def patch_sums(grid: DataFrame, p: int, *values: str, inclusive_edge: bool = False) -> DataFrame:
    """(image_id, y, x, values...) over p x p patches. Origins run to height - p - 1 and width - p - 1, or one further with
    inclusive_edge. Running sums and a look-ahead, so the cost doesn't depend on p."""
    out = grid.select("image_id", "y", "x", *values)
    for w in _axes():
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"_{v}": F.sum(v).over(run) for v in values})
        out = out.withColumns({v: F.lead(f"_{v}", p - 1).over(w) - F.col(f"_{v}") + F.col(v) for v in values}).drop(*[f"_{v}" for v in values])
    more = 1 if inclusive_edge else 0
    fits = (F.col("y") < F.col("height") - p + more) & (F.col("x") < F.col("width") - p + more)
    return out.join(F.broadcast(dims(grid)), "image_id").where(fits).select("image_id", "y", "x", *values)


def candidates(mask: DataFrame, p: int, inclusive_edge: bool = False) -> DataFrame:
    """(image_id, y, x) of patches that lie in valid pixels only; mask is dense (image_id, y, x, valid)."""
    grid = mask.select("image_id", "y", "x", F.col("valid").cast("int").alias("n"))
    return patch_sums(grid, p, "n", inclusive_edge=inclusive_edge).where(F.col("n") == p * p).select("image_id", "y", "x")


def patch_stats(pixels: DataFrame, p: int, inclusive_edge: bool = True) -> DataFrame:
    """(image_id, y, x, mean, var): mean and population variance over all values of a patch, for every origin."""
    cells = pixels.groupBy("image_id", "y", "x").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    sums = patch_sums(cells, p, "s", "q", "n", inclusive_edge=inclusive_edge)
    mean = F.col("s") / F.col("n")
    return sums.select("image_id", "y", "x", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("var"))


def good(mean: str = "mean", var: str = "var") -> Column:
    """Neither too dark nor too flat."""
    return (F.col(mean) >= BLACK) & (F.col(var) >= VARIANCE)
