"""Adaptive arcsinh stretch: percentiles a channel (or an image), then a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from .quantiles import quantiles

BLACK, WHITE = 1.0, 99.7


def stretch_params(pixels: DataFrame, black: float = BLACK, white: float = WHITE, linked: bool = False) -> DataFrame:
    """(image_id, c, black, white): exact percentiles of the cleaned values; linked: the image's own for each channel."""
    clean = pixels.select("image_id", "c", pixel.finite_or_zero(F.col("v")).alias("v"))
    found = quantiles(clean, ["image_id"] if linked else ["image_id", "c"], F.col("v"), [black / 100, white / 100])
    if linked:
        found = found.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return found.select("image_id", "c", lo.alias("black"), F.when(hi <= lo, lo + 1e-10).otherwise(hi).alias("white"))


def apply_stretch(pixels: DataFrame, params: DataFrame, k: float = pixel.STRETCH) -> DataFrame:
    joined = pixels.join(F.broadcast(params), ["image_id", "c"])  # three rows an image
    return joined.select("image_id", "y", "x", "c", pixel.arcsinh_stretch(F.col("v"), F.col("black"), F.col("white"), k).alias("v"))


def stretch(pixels: DataFrame, linked: bool = False) -> DataFrame:
    return apply_stretch(pixels, stretch_params(pixels, linked=linked))


def stretch_paired(noisy: DataFrame, paired: DataFrame) -> DataFrame:
    """Both frames stretched by the noisy one's parameters, with a side column."""
    params = stretch_params(noisy)
    return apply_stretch(noisy, params).withColumn("side", F.lit("noisy")).unionByName(apply_stretch(paired, params).withColumn("side", F.lit("paired")))
