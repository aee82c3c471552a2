"""The degradation combinations: shared nodes, seven branches, one join with the crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import crops as cropping
from ..operators.defects import delta, transplant
from ..operators.degrade import degrade
from ..storage import materialize

KINDS = ("stars", "defects", "lowres")


def combo_names() -> list[str]:
    """All non-empty subsets of the three kinds, by bit mask 1 to 7."""
    return ["_".join(k for i, k in enumerate(KINDS) if mask >> i & 1) for mask in range(1, 1 << len(KINDS))]


def requantised(pixels: DataFrame) -> DataFrame:
    """Through 16 bits and back: what passing frames on as TIFF does."""
    return pixels.withColumn("v", pixel.dequantise(pixel.quantise_truncating(F.col("v"))))


def branches(clean: DataFrame, starred: DataFrame, original: DataFrame, corrected: DataFrame, scale: int = 4, sigma: float = 1.5) -> dict[str, DataFrame]:
    """Name to pixels. Stars come first, then low resolution, defects always last. starred is clean with injected stars;
    it and clean should be tables."""
    low, starred_low = (materialize(degrade(df, scale, sigma), "low") for df in (clean, requantised(starred)))
    moved = materialize(delta(original, corrected), "delta")
    defect = lambda df: transplant(df, original, corrected, moved=moved)
    return {
        "stars": starred, "defects": defect(clean), "stars_defects": defect(starred), "lowres": low,
        "stars_lowres": starred_low, "defects_lowres": defect(low), "stars_defects_lowres": defect(starred_low),
    }


def union(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("combo", F.lit(name)) for name, df in parts.items()])


def merged_pairs(parts: dict[str, DataFrame], clean: DataFrame, crops: DataFrame, p: int) -> DataFrame:
    """(combo, image_id, crop_index, side, y, x, c, v): every combo's input, and the clean target, on the same crops."""
    return cropping.combined_pairs(materialize(union(parts), "combos"), clean, crops, p)


def alignment(pairs: DataFrame) -> DataFrame:
    """(image_id, crop_index, combos, targets): targets is 1 where all combos share one target patch."""
    cell = F.xxhash64("y", "x", "c", F.round("v", 9))
    target = pairs.where(F.col("side") == "target").groupBy("combo", "image_id", "crop_index").agg(F.bit_xor(cell).alias("h"), F.count("*").alias("n"))
    return target.groupBy("image_id", "crop_index").agg(F.count("*").alias("combos"), F.count_distinct("h", "n").alias("targets"))
