"""The data model: pixels(image_id, y, x, c, v) and its dense twin frames(image_id, height, width, channels, data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import numbering

#: Ids of a block in which an image's rows are numbered.
BLOCK = 4_096
PIXELS = "image_id string, y int, x int, c int, v double"
FRAMES = "image_id string, height int, width int, channels int, data array<float>"
CROPS = "image_id string, crop_index int, y int, x int, flip_h boolean, flip_v boolean, rot_k int"


def stem(path: Column) -> Column:
    """File name without folders and last suffix; the implicit key of all files."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def pixels_from_vectors(vectors: DataFrame, values: int = 63, channels: int = 3) -> DataFrame:
    """(vec_id, embedding, label) as rasters: one image a label, one row of pixels a vector."""
    kept = vectors.select(F.col("label").cast("string").alias("image_id"), "vec_id", F.slice("embedding", 1, values).alias("row")).where("label is not null")
    rows = numbering.numbered(kept, ["vec_id"], ["image_id"], F.expr(f"vec_id div {BLOCK}"), "y").withColumn("y", F.col("y").cast("int"))  # numbered before they are exploded
    flat = rows.select("image_id", "y", F.posexplode("row").alias("p", "v"))
    at = F.expr(f"cast(p div {channels} as int)")
    return flat.select("image_id", "y", at.alias("x"), (F.col("p") % channels).alias("c"), F.col("v").cast("double").alias("v"))


def dims(pixels: DataFrame) -> DataFrame:
    """(image_id, height, width)."""
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def pixels_from_frames(frames: DataFrame) -> DataFrame:
    """Row-major height x width x channels data to pixels; grey frames get three channels, a fourth channel is dropped."""
    flat = frames.select("image_id", "width", "channels", F.posexplode("data").alias("p", "v"))
    line = F.col("width") * F.col("channels")
    at = flat.select(
        "image_id", F.floor(F.col("p") / line).cast("int").alias("y"), F.floor((F.col("p") % line) / F.col("channels")).cast("int").alias("x"),
        "channels", (F.col("p") % F.col("channels")).cast("int").alias("k"), F.col("v").cast("double").alias("v"),
    )
    c = F.explode(F.when(F.col("channels") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array("k")))
    return at.select("image_id", "y", "x", c.alias("c"), "v").where("c < 3")


def frames_from_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels to one row an image; an image's pixels meet in one task, so this is for frames that fit in one."""
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("c") + 1).alias("channels"))
    rows = F.array_sort(F.collect_list(F.struct("y", "x", "c", F.col("v").cast("float").alias("v"))))
    return pixels.groupBy("image_id").agg(F.transform(rows, lambda r: r["v"]).alias("data")).join(size, "image_id").select("image_id", "height", "width", "channels", "data")
