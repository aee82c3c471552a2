"""The low-resolution model: Gaussian blur, then cubic-spline zoom down and up, all in bounded pieces along an axis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from ..model import dims
from .joins import shuffled
from .stencil import gaussian

SCALE, BLUR = 4, 1.5
#: The pole of the cubic spline's filter, and after how many pixels its powers are below a double's last digit.
POLE, REACH = math.sqrt(3) - 2, 28
#: Pixels of a line that are resized together, and how far they see to either side.
BLOCK, HALO = 256, REACH + 4


def _reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond a line's ends, mirrored about the centres of its outer pixels as often as it takes."""
    i = np.abs(i) % max(2 * n - 2, 1)
    return np.minimum(i, 2 * n - 2 - i)


def _fold(values: np.ndarray, forward: bool) -> np.ndarray:
    """At each place the sum of REACH + 1 neighbours along a row, weighed by the pole's powers."""
    width, total = values.shape[1] - REACH, 0.0
    for k in range(REACH + 1) if forward else range(REACH, -1, -1):
        total = total * POLE + values[:, k : k + width]
    return total


def resampled(values: np.ndarray, low: int, start: int, stop: int, n_in: int, n_out: int) -> tuple[int, np.ndarray]:
    """The first new pixel that the old ones from start to before stop give, and a row of new pixels for each row of old
    ones (from place low on). Spline coefficients are a causal fold, then an anticausal one, over the REACH pixels that a
    double can tell; a new pixel comes from the coefficient of the old one before it and three neighbouring ones."""
    padded = values[:, _reflected(np.arange(start - REACH - 1, stop + REACH + 2), n_in) - low]
    spread = _fold(_fold(padded, True), False) * (-6 * POLE)  # from start - 1 to stop + 1
    if n_in == 1 or n_out == 1:
        first, old, t = 0, np.zeros(n_out if start == 0 else 0, int), 0.0
    else:
        firsts = np.ceil(np.arange(start, stop + 1) * (n_out - 1) / (n_in - 1)).astype(int)
        firsts[-1] = n_out if stop == n_in else firsts[-1]
        first, old = firsts[0], np.repeat(np.arange(start, stop), np.diff(firsts))
        t = (np.arange(first, firsts[-1]) * (n_in - 1) - old * (n_out - 1)) / (n_out - 1)
    before, at, following, later = (spread[:, old - start + k] for k in range(4))
    return first, (before * (1 - t) ** 3 + at * (3 * t**3 - 6 * t * t + 4) + following * (-3 * t**3 + 3 * t * t + 3 * t + 1) + later * t**3) / 6


def _resampled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal place and size are the rows of one matrix. Pixels that a line lacks are NaN."""
    for batch in batches:
        cells = batch.column("cells")
        lengths = np.diff(cells.offsets.to_numpy())
        row_of, (i, v) = np.repeat(np.arange(batch.num_rows), lengths), (c.to_numpy(zero_copy_only=False) for c in cells.flatten().flatten())
        where = np.stack([batch.column(c).to_numpy() for c in ("block", "n_in", "n_out")], axis=1)
        kinds, kind_of = np.unique(where, axis=0, return_inverse=True)
        kind_of = kind_of.reshape(-1)
        # rows and cells in the order of their kinds, so that each kind is a stretch
        row_order, cell_order = np.argsort(kind_of, kind="stable"), np.argsort(kind_of[row_of], kind="stable")
        row_ends, cell_ends = (np.r_[0, np.cumsum(np.bincount(k, minlength=len(kinds)))] for k in (kind_of, kind_of[row_of]))
        place = np.empty(batch.num_rows, int)
        for kind, (block, n_in, n_out) in enumerate(kinds.tolist()):
            start, stop = block * BLOCK, min(block * BLOCK + BLOCK, n_in)
            low, high = max(start - HALO, 0), min(stop + HALO, n_in)
            rows, mine = row_order[row_ends[kind] : row_ends[kind + 1]], cell_order[cell_ends[kind] : cell_ends[kind + 1]]
            place[rows] = np.arange(len(rows))
            values = np.full((len(rows), high - low), np.nan)
            values[place[row_of[mine]], i[mine] - low] = v[mine]
            first, made = resampled(values, low, start, stop, n_in, n_out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1)))
            kept = batch.select(["image_id", "other", "c"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(rows), first, np.int32)), lists], names=["image_id", "other", "c", "first", "made"])


def resize(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels at new sizes (image_id, height, width, new_height, new_width), values not clipped: corner-aligned cubic
    splines with mirrored borders. Lines are cut into blocks of BLOCK pixels, with HALO neighbours on either side, so a
    group is bounded however long a line is; borders are mirrored inside of a block and give no rows."""
    out = pixels.select("image_id", "y", "x", "c", "v")
    for axis, size, other in (("y", "height", "x"), ("x", "width", "y")):
        at, n = F.col(axis), F.col("n_in")
        near = [F.floor((at + d) / BLOCK).cast("int") for d in (0, -HALO, HALO)]
        block = F.explode(F.filter(F.array_distinct(F.array(*near)), lambda b: (b >= 0) & (b * BLOCK < n)))
        sized = out.join(F.broadcast(sizes.select("image_id", F.col(size).alias("n_in"), F.col(f"new_{size}").alias("n_out"))), "image_id")
        cells = sized.select("image_id", F.col(other).alias("other"), "c", "n_in", "n_out", block.alias("block"), F.struct(at.alias("i"), "v").alias("cell"))
        blocks = cells.groupBy("image_id", "other", "c", "block", "n_in", "n_out").agg(F.collect_list("cell").alias("cells"))
        made = blocks.mapInArrow(_resampled_blocks, "image_id string, other int, c int, first int, made array<double>")
        placed = made.select("image_id", F.col("other").alias(other), "c", "first", F.posexplode("made").alias("k", "v"))
        out = placed.select("image_id", (F.col("first") + F.col("k")).alias(axis), other, "c", "v")
    return out


def _rounded(size: str, factor: float) -> Column:
    return F.greatest(F.lit(1), F.rint(F.col(size) * factor).cast("int"))


def shrunk(size: DataFrame, scale: int = SCALE) -> DataFrame:
    """Adds new_height and new_width, a scale-th of (image_id, height, width)."""
    return size.withColumn("new_height", _rounded("height", 1.0 / scale)).withColumn("new_width", _rounded("width", 1.0 / scale))


def zoom_down(pixels: DataFrame, scale: int = SCALE) -> DataFrame:
    return resize(pixels, shrunk(dims(pixels), scale)).withColumn("v", pixel.clip(F.col("v")))


def zoom_to(pixels: DataFrame, target: DataFrame) -> DataFrame:
    """Pixels zoomed to the dims (image_id, height, width) of target, clipped."""
    to = target.select("image_id", F.col("height").alias("new_height"), F.col("width").alias("new_width"))
    return resize(pixels, dims(pixels).join(to, "image_id")).withColumn("v", pixel.clip(F.col("v")))


def match_shape(pixels: DataFrame, target: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Cut or zero-padded at the bottom and right to target's (image_id, height, width), channels as they are; channels
    (image_id, c) tells them without reading pixels twice."""
    held = (pixels if channels is None else channels).groupBy("image_id").agg(F.collect_set("c").alias("cs"))
    sized = target.join(held, "image_id")  # a row an image on both sides; the grid is made after it
    rows = sized.select("image_id", "width", "cs", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    full = rows.select("image_id", "y", "cs", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")).select("image_id", "y", "x", F.explode("cs").alias("c"))
    keys = ["image_id", "y", "x", "c"]
    return full.join(shuffled(pixels.select(*keys, "v")), keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).alias("v"))


def degrade(pixels: DataFrame, scale: int = SCALE, sigma: float = BLUR) -> DataFrame:
    """Blurred, made smaller and as large as before again. All sizes come from the input's, so nothing is made twice."""
    size = dims(pixels)
    small = shrunk(size, scale)
    back = small.select("image_id", F.col("new_height").alias("height"), F.col("new_width").alias("width"), F.col("height").alias("new_height"), F.col("width").alias("new_width"))
    low = resize(gaussian(pixels, sigma), small).withColumn("v", pixel.clip(F.col("v")))
    return match_shape(resize(low, back).withColumn("v", pixel.clip(F.col("v"))), size, pixels)
