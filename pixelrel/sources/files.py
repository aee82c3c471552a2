"""Image files as frames, and frames as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel
from ..model import CROPS, FRAMES, frames_from_pixels, stem
from . import frames
from .frames import SUFFIXES

def listing(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(image_id, suffix, path) of a folder's files of a kind, whichever of its suffixes they have."""
    globs = f"*.{{{','.join(s[1:] for s in SUFFIXES[kind])}}}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", globs).load(folder).select("path")
    return files.select(stem(F.col("path")).alias("image_id"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("suffix"), "path")


def listings(spark: SparkSession, *places: tuple[str, str]) -> DataFrame:
    """The listings of several (folder, kind) one after the other, with their place from 0."""
    parts = [listing(spark, folder, kind).withColumn("place", F.lit(i)) for i, (folder, kind) in enumerate(places)]
    return reduce(DataFrame.unionByName, parts)


def read_frames(spark: SparkSession, folder: str, kind: str, **options: str) -> DataFrame:
    """FRAMES, reject and path: see sources.frames for kinds and options."""
    return frames.register(spark).read.format("frames").options(path=folder, kind=kind, **options).load()


def write_frames(rows: DataFrame, folder: str, kind: str = "npy", values: str = "float", mode: str = "append") -> None:
    """Writes a file a frame, <folder>/<image_id> with the suffix of the kind."""
    frames.register(rows.sparkSession)
    rows.select(*[c.split()[0] for c in FRAMES.split(", ")]).write.format("frames").options(kind=kind, values=values).mode(mode).save(folder)


def read_masks(spark: SparkSession, folder: str, kind: str = "npy") -> DataFrame:
    """(image_id, y, x, valid) of mask files with one channel: what isn't 0 is valid."""
    good = read_frames(spark, folder, kind).where("reject is null and channels = 1")
    flat = good.select("image_id", "width", F.posexplode("data").alias("p", "v"))
    return flat.select("image_id", F.expr("cast(p div width as int)").alias("y"), (F.col("p") % F.col("width")).alias("x"), (F.col("v") != 0).alias("valid"))


def mask_frames(mask: DataFrame) -> DataFrame:
    """A validity mask as FRAMES of one channel, 0 or 1; one mask meets in one task, as its file wants."""
    return frames_from_pixels(mask.select("image_id", "y", "x", F.lit(0).alias("c"), F.col("valid").cast("double").alias("v")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A crop manifest (patch_size, seed, entries) as CROPS."""
    entry = "basename string, crop_index int, y int, x int, flip_h boolean, flip_v boolean, rot_k int"
    rows = spark.read.schema(f"patch_size int, seed int, entries array<struct<{', '.join(f.replace(' ', ': ', 1) for f in entry.split(', '))}>>").json(path, multiLine=True)
    return rows.select(F.explode("entries").alias("e")).select(F.col("e.basename").alias("image_id"), *[f"e.{f.split()[0]}" for f in CROPS.split(", ")[1:]])


def manifest_json(crops: DataFrame, p: int, seed: int) -> DataFrame:
    """One row (value) with the manifest; its crops meet in one row, as the format wants."""
    entry = F.struct(F.col("image_id").alias("basename"), "crop_index", "y", "x", "flip_h", "flip_v", "rot_k")
    whole = F.struct(F.lit(p).alias("patch_size"), F.lit(seed).alias("seed"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return crops.agg(F.to_json(whole).alias("value"))


def keys_missing(value: Column, required: list[str]) -> Column:
    """Keys that JSON objects should have and haven't; null where a value is no object."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(value)))


def quantised(pixels: DataFrame, how: str) -> DataFrame:
    """v as stored: trunc16, rint16, u8 or mask (0/255)."""
    v = F.col("v")
    made = {"trunc16": pixel.quantise_truncating(v), "rint16": pixel.quantise_rounding(v), "u8": pixel.quantise_truncating(v, 255), "mask": F.when(v > 0, 255).otherwise(0)}
    return pixels.withColumn("q", made[how])
