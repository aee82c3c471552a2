"""Validity masks from local variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from .stencil import box

THRESHOLD, WINDOW, CHANNEL = 1e-5, 16, 1


def local_variance(pixels: DataFrame, window: int = WINDOW, channel: int = CHANNEL) -> DataFrame:
    """(image_id, y, x, height, width, mean, var) of one channel; var is E[v^2] - E[v]^2, at least 0."""
    green = pixels.where(F.col("c") == channel).withColumn("v", pixel.finite_or_largest(F.col("v"))).withColumn("q", F.col("v") * F.col("v"))
    means = box(green, window, "v", "q")
    return means.select("image_id", "y", "x", "height", "width", F.col("v").alias("mean"), F.greatest(F.lit(0.0), F.col("q") - F.col("v") * F.col("v")).alias("var"))


def validity_mask(pixels: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, margin: int = 0, channel: int = CHANNEL) -> DataFrame:
    """(image_id, y, x, valid): variance over the threshold, and not within margin of any side."""
    valid = F.col("var") > threshold
    if margin > 0:
        valid = valid & (F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") < F.col("height") - margin) & (F.col("x") < F.col("width") - margin)
    return local_variance(pixels, window, channel).select("image_id", "y", "x", valid.alias("valid"))


def valid_fraction(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg((F.avg(F.col("valid").cast("int")) * 100).alias("valid_pct"), F.count_if("valid").alias("valid_area"))
