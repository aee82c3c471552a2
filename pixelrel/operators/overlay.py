"""Previews of validity masks: a stretched grey frame, made smaller, with what is invalid in red."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from ..model import dims, frames_from_pixels
from .quantiles import quantiles

LOW, HIGH, MAX_SIZE, CHANNEL = 0.01, 0.995, 1024, 1
#: The colour of what is invalid, and the least range between black and white.
RED, LEAST = (220, 50, 50), 1e-6
AT = ["image_id", "y", "x"]


def preview_range(grey: DataFrame) -> DataFrame:
    """(image_id, black, white) of (image_id, v, valid): two percentiles of the valid pixels, or of all pixels where none
    is valid; both null where those are all alike."""
    counted = grey.groupBy("image_id").agg(F.bool_or("valid").alias("some"))
    used = grey.join(counted, "image_id").where(F.col("valid") | ~F.col("some"))
    p = quantiles(used, ["image_id"], F.col("v"), [0.0, LOW, HIGH, 1.0])
    flat, black, white = F.col("p")[0] == F.col("p")[3], F.col("p")[1], F.col("p")[2]
    return p.select("image_id", F.when(~flat, black).alias("black"), F.when(~flat, F.when(white <= black, black + LEAST).otherwise(white)).alias("white"))


def preview(pixels: DataFrame, mask: DataFrame, max_size: int = MAX_SIZE, channel: int = CHANNEL) -> DataFrame:
    """(image_id, y, x, red, green, blue int): sides of at most max_size. A small pixel is the mean of the 8-bit values of
    its cell, and red where the pixel in the middle of the cell is invalid."""
    grey = pixels.where(F.col("c") == channel).select(*AT, "v").join(mask.select(*AT, "valid"), AT)
    scale = F.least(F.lit(max_size) / F.col("height"), F.lit(max_size) / F.col("width"), F.lit(1.0))
    small = lambda side: F.greatest(F.lit(1), F.floor(F.col(side) * scale)).cast("int")
    size = dims(pixels).select("image_id", "height", "width", small("height").alias("th"), small("width").alias("tw"))
    level = F.when(F.col("black").isNull(), 0).otherwise(F.floor(pixel.clip((F.col("v") - F.col("black")) / (F.col("white") - F.col("black"))) * 255))
    told = grey.join(size, "image_id").join(preview_range(grey), "image_id").withColumn("level", level)
    ty, tx = F.expr("cast(y * th div height as int)"), F.expr("cast(x * tw div width as int)")
    middle = F.expr("y = (2 * (y * th div height) + 1) * height div (2 * th) and x = (2 * (x * tw div width) + 1) * width div (2 * tw)")
    cells = told.select("image_id", ty.alias("ty"), tx.alias("tx"), "level", F.when(middle, F.col("valid")).alias("seen"))
    made = cells.groupBy("image_id", "ty", "tx").agg(F.floor(F.avg("level") + 0.5).cast("int").alias("level"), F.bool_or("seen").alias("seen"))
    shade = [F.when(F.col("seen"), F.col("level")).otherwise(F.lit(c)).alias(name) for name, c in zip(("red", "green", "blue"), RED)]
    return made.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *shade)


def preview_frames(made: DataFrame) -> DataFrame:
    """A preview as FRAMES of 0 to 1, to be written as PNG; a preview is small, so each meets in one task."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).alias("level")) for i, n in enumerate(("red", "green", "blue"))]))
    flat = made.select(*AT, at.alias("s"))
    # a half above the level, so that truncating to 8 bits gives the level again
    return frames_from_pixels(flat.select(*AT, "s.c", ((F.col("s.level") + 0.5) / 255).alias("v")))
