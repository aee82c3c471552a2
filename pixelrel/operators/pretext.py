"""Generic degradations for pretraining: each image gets a chain of one to three of four operations, drawn by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel, rng
from ..model import dims
from ..storage import materialize
from . import degrade, stencil

OPERATIONS, MOST, ZEROED, SEED = ("noise", "blur", "lowres", "occlusion"), 3, 0.1, 42
#: What the operations draw from: noise levels, blur widths, scales, and occlusions an image and their side by its own.
LEVELS, SIGMAS, SCALES, SPOTS, SIDE = (0.01, 0.08), (0.8, 1.5, 2.2), (2, 4), 3, 8
AT = ["image_id", "y", "x", "c"]


def chains(images: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, zeroed, step, operation): one to MOST different operations an image, in the order that they apply in;
    a zeroed image is black in the end, whatever its chain."""
    keyed = F.array_sort(F.array(*[F.struct(rng.key(seed, op, "image_id").alias("k"), F.lit(op).alias("op")) for op in OPERATIONS]))
    n = (rng.choice(rng.key(seed, "length", "image_id"), F.lit(MOST)) + 1).cast("int")
    drawn = images.select("image_id", rng.bernoulli(rng.key(seed, "zero", "image_id"), ZEROED).alias("zeroed"), F.posexplode(F.slice(keyed, F.lit(1), n)).alias("step", "o"))
    return drawn.select("image_id", "zeroed", "step", F.col("o.op").alias("operation"))


def noise(pixels: DataFrame, seed: int = SEED) -> DataFrame:
    """Noise that grows with the root of the light, of a level drawn by image."""
    level = rng.uniform(rng.key(seed, "level", "image_id")) * (LEVELS[1] - LEVELS[0]) + LEVELS[0]
    e = rng.normal(rng.key(seed, "noise", *AT), rng.key(seed, "turn", *AT))
    return pixels.select(*AT, pixel.clip(F.col("v") + e * level * F.sqrt(F.lit(0.1) + F.greatest(F.col("v"), F.lit(0.0)))).alias("v"))


def blur(pixels: DataFrame, seed: int = SEED) -> DataFrame:
    """A Gaussian of a width drawn by image."""
    drawn = pixels.withColumn("w", rng.choice(rng.key(seed, "width", "image_id"), F.lit(len(SIGMAS))))
    return reduce(DataFrame.unionByName, [stencil.gaussian(drawn.where(F.col("w") == i).drop("w"), sigma) for i, sigma in enumerate(SIGMAS)])


def lowres(pixels: DataFrame, seed: int = SEED) -> DataFrame:
    """Smaller by a scale drawn by image, and as large as before again."""
    size = dims(pixels)
    scale = F.element_at(F.array(*map(F.lit, SCALES)), (rng.choice(rng.key(seed, "scale", "image_id"), F.lit(len(SCALES))) + 1).cast("int"))
    small = lambda side: F.greatest(F.lit(1), F.rint(F.col(side) / scale).cast("int"))
    down = degrade.resize(pixels, size.select("*", small("height").alias("new_height"), small("width").alias("new_width")))
    return degrade.zoom_to(materialize(down.withColumn("v", pixel.clip(F.col("v"))), "small"), size)


def spots(size: DataFrame, seed: int = SEED) -> DataFrame:
    """(image_id, spot, y0, x0, y1, x1), ends exclusive: SPOTS boxes an image, a SIDE-th of its sides long."""
    k = lambda purpose: rng.key(seed, purpose, "image_id", "spot")
    long = lambda side: F.greatest(F.lit(1), F.floor(F.col(side) / SIDE)).cast("int")
    boxes = size.withColumn("spot", F.explode(F.sequence(F.lit(0), F.lit(SPOTS - 1)))).withColumn("y0", rng.choice(k("top"), F.col("height")).cast("int")).withColumn("x0", rng.choice(k("left"), F.col("width")).cast("int"))
    return boxes.select("image_id", "spot", "y0", "x0", F.least("height", F.col("y0") + long("height")).alias("y1"), F.least("width", F.col("x0") + long("width")).alias("x1"))


def occlusion(pixels: DataFrame, seed: int = SEED) -> DataFrame:
    """A few boxes are filled with their own mean by channel; where boxes overlap the first one counts."""
    rows = spots(dims(pixels), seed).withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    cells = rows.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).groupBy("image_id", "y", "x").agg(F.min("spot").alias("spot"))
    marked = pixels.join(cells, ["image_id", "y", "x"], "left")
    fill = marked.where("spot is not null").groupBy("image_id", "spot", "c").agg(F.avg("v").alias("fill"))
    return marked.join(fill, ["image_id", "spot", "c"], "left").select(*AT, F.coalesce("fill", "v").alias("v"))


def conditions(pixels: DataFrame, seed: int = SEED) -> DataFrame:
    """The degraded twins of clean frames: each step of the chains is one pass over the images that are still in it."""
    work = {"noise": noise, "blur": blur, "lowres": lowres, "occlusion": occlusion}
    drawn = materialize(chains(pixels.select("image_id").distinct(), seed), "chains")
    out = pixels.select(*AT, "v")
    for step in range(MOST):
        now = drawn.where(F.col("step") == step).select("image_id", "operation")
        parts = [work[op](out.join(now.where(F.col("operation") == op).select("image_id"), "image_id", "left_semi"), seed + step) for op in OPERATIONS]
        out = materialize(reduce(DataFrame.unionByName, [*parts, out.join(now, "image_id", "left_anti")]), "step")
    black = drawn.where("zeroed").select("image_id").distinct().withColumn("black", F.lit(True))
    return out.join(black, "image_id", "left").select(*AT, F.when(F.col("black"), 0.0).otherwise(F.col("v")).alias("v"))
