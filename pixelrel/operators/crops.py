"""Crop manifests, augmentation, extraction and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel, rng
from ..model import dims
from ..storage import materialize
from . import numbering
from .defects import difference
from .integral import candidates, good, patch_stats, patch_sums
from .joins import shuffled

PATCH, CROPS, SEED, RETRIES, DEFECT_RATIO, MIN_DEFECTS = 256, 50, 42, 10, 0.8, 1
AT = ["image_id", "y", "x"]
#: A table of up to so many crops (four cells each) is sent to the pixels; with more, or uncounted, both sides are shuffled.
FEW = 50_000


def numbered(origins: DataFrame) -> DataFrame:
    """(image_id, y, x, k): candidates numbered row by row from 0."""
    return numbering.numbered(origins.select(*AT), ["y", "x"], ["image_id"], F.col("y"))


def attempts(images: DataFrame, crops: int, retries: int) -> DataFrame:
    """The grid of tries: (image_id, crop_index, attempt) for every image."""
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(crops - 1))).alias("crop_index"))
    return grid.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))


def first_good(tries: DataFrame, pool: DataFrame, stats: DataFrame, seed: int) -> DataFrame:
    """(image_id, crop_index, y, x): the first try whose hash-chosen origin passes the quality gate. Crops without one
    are absent and leave a gap in crop_index."""
    sized = pool.groupBy("image_id").agg(F.count("*").alias("n"))
    chosen = tries.join(sized, "image_id").withColumn("k", rng.choice(rng.key(seed, "position", "image_id", "crop_index", "attempt"), F.col("n")))
    placed = chosen.join(shuffled(numbered(pool)), ["image_id", "k"]).join(shuffled(stats), AT).where(good())
    best = placed.groupBy("image_id", "crop_index").agg(F.min_by(F.struct("y", "x"), "attempt").alias("at"))
    return best.select("image_id", "crop_index", "at.y", "at.x")


def augmented(crops: DataFrame, seed: int) -> DataFrame:
    """Adds flip_h, flip_v and rot_k, drawn for accepted crops by their own key."""
    k = rng.key(seed, "augment", "image_id", "crop_index")
    return crops.select("*", (rng.bits(k, 0) == 1).alias("flip_h"), (rng.bits(k, 1) == 1).alias("flip_v"), rng.bits(k, 2, 2).alias("rot_k"))


def crop_manifest(reference: DataFrame, mask: DataFrame, p: int = PATCH, crops: int = CROPS, seed: int = SEED, retries: int = RETRIES, inclusive_edge: bool = False) -> DataFrame:
    """Crops of each image that has both a mask and a reference of one shape; the gate looks at the reference."""
    pool = candidates(mask.join(F.broadcast(same_shape(dims(mask), dims(reference))), "image_id", "left_semi"), p, inclusive_edge)
    tries = attempts(pool.select("image_id").distinct(), crops, retries)
    return augmented(first_good(tries, pool, patch_stats(reference, p), seed), seed)


def defect_biased_crops(frame: DataFrame, defect: DataFrame, mask: DataFrame, p: int = PATCH, crops: int = CROPS, seed: int = SEED, retries: int = RETRIES, ratio: float = DEFECT_RATIO, least: int = MIN_DEFECTS) -> DataFrame:
    """As crop_manifest, but a crop draws with the given ratio from origins whose patch holds at least so many defect
    pixels (image_id, y, x), if the image has such; the gate looks at frame."""
    pool = candidates(mask, p)
    grid = mask.select(*AT).join(shuffled(defect.select(*AT, F.lit(1).alias("d"))), AT, "left").withColumn("d", F.coalesce("d", F.lit(0)))
    rich = patch_sums(grid, p, "d").where(F.col("d") >= least).join(shuffled(pool), AT).select(*AT)
    tries = attempts(pool.select("image_id").distinct(), crops, retries)
    with_rich = rich.select("image_id").distinct().withColumn("rich", F.lit(True))
    wants = F.coalesce("rich", F.lit(False)) & rng.bernoulli(rng.key(seed, "pool", "image_id", "crop_index"), ratio)
    tries = tries.join(with_rich, "image_id", "left").withColumn("from_rich", wants).drop("rich")
    stats = patch_stats(frame, p)
    parts = [first_good(tries.where(F.col("from_rich") == flag).drop("from_rich"), origins, stats, seed).withColumn("from_rich", F.lit(flag)) for flag, origins in ((True, rich), (False, pool))]
    return augmented(parts[0].unionByName(parts[1]), seed)


def extract(pixels: DataFrame, crops: DataFrame, p: int = PATCH) -> DataFrame:
    """(image_id, crop_index, y, x, c, v), y and x inside the turned patch. Crops go to the p x p cells they touch (at most
    four), so the range join is an equi-join. Crops that leave the frame are left out, see rejected()."""
    return _cut(pixels, within(crops, pixels, p), p)


def within(crops: DataFrame, pixels: DataFrame, p: int = PATCH) -> DataFrame:
    """The crops that lie whole inside their frame."""
    held = crops.join(F.broadcast(dims(pixels)), "image_id")
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") + p <= F.col("height")) & (F.col("x") + p <= F.col("width"))
    return held.where(inside).drop("height", "width")


def _cut(pixels: DataFrame, crops: DataFrame, p: int, *more: str, few: bool = False) -> DataFrame:
    """more: further columns of pixels that the patches keep, such as the combination they belong to. few: crops were counted
    and can be broadcast."""
    k = lambda a: F.floor(F.col(a) / p).cast("int")
    spread = lambda a: F.explode(F.array_distinct(F.array(k(a), F.floor((F.col(a) + p - 1) / p).cast("int"))))
    placed = crops.withColumnsRenamed({"y": "y0", "x": "x0"}).withColumn("cell_y", spread("y0")).withColumn("cell_x", spread("x0"))
    cells = pixels.select("image_id", "y", "x", "c", "v", *more, k("y").alias("cell_y"), k("x").alias("cell_x"))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + p) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + p)
    cut = cells.join(F.broadcast(placed) if few else shuffled(placed), ["image_id", "cell_y", "cell_x"]).where(inside)
    y, x = pixel.turned(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"), F.lit(p), F.lit(p), F.col("flip_h"), F.col("flip_v"), F.col("rot_k"))
    return cut.select("image_id", "crop_index", y.alias("y"), x.alias("x"), "c", "v", *more)


def rejected(crops: DataFrame, size: DataFrame, p: int = PATCH) -> DataFrame:
    """(image_id, crop_index, reason) of crops without a frame or over its edge."""
    joined = crops.join(size, "image_id", "left")
    reason = F.when(F.col("height").isNull(), "no frame").when((F.col("y") + p > F.col("height")) | (F.col("x") + p > F.col("width")) | (F.col("y") < 0) | (F.col("x") < 0), "out of bounds")
    return joined.select("image_id", "crop_index", reason.alias("reason")).where("reason is not null")


def patches(pixels: DataFrame, crops: DataFrame, p: int = PATCH) -> DataFrame:
    """(image_id, crop_index, name, data array<float>): whole patches, row by row, channel last."""
    rows = extract(pixels, crops, p)
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "c", F.col("v").cast("float").alias("v")))), lambda r: r["v"])
    name = F.format_string("%s_%04d", F.col("image_id"), F.col("crop_index"))
    return rows.groupBy("image_id", "crop_index").agg(data.alias("data")).select("image_id", "crop_index", name.alias("name"), "data")


def same_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_ids whose (image_id, height, width) agree."""
    return a.join(b, ["image_id", "height", "width"]).select("image_id")


def shape_rejects(source: DataFrame, p: int = PATCH, **others: DataFrame) -> DataFrame:
    """(image_id, reason) of source images that a builder skips: under p pixels, without one of the others (relations with
    image_id, y and x: the target, a mask), or of another height or width than it. The first reason found counts."""
    size = dims(source)
    reason = F.when((F.col("height") < p) | (F.col("width") < p), "too small")
    for name, other in others.items():
        size = size.join(dims(other).select("image_id", F.col("height").alias(f"h_{name}"), F.col("width").alias(f"w_{name}")), "image_id", "left")
        differs = (F.col(f"h_{name}") != F.col("height")) | (F.col(f"w_{name}") != F.col("width"))
        reason = reason.when(F.col(f"h_{name}").isNull(), f"no {name}").when(differs, f"{name} of another shape")
    return size.select("image_id", reason.alias("reason")).where("reason is not null")


def _sides(source: DataFrame, target: DataFrame, crops: DataFrame, p: int) -> DataFrame:
    return _cut(source, crops, p).withColumn("side", F.lit("input")).unionByName(_cut(target, crops, p).withColumn("side", F.lit("target")))


def pairs(source: DataFrame, target: DataFrame, crops: DataFrame, p: int = PATCH) -> DataFrame:
    """(image_id, crop_index, side, y, x, c, v): the same crops, turned alike, from input and target. Images whose shapes
    differ and crops that leave the frame are left out on both sides."""
    kept = within(crops, source, p).join(same_shape(dims(source), dims(target)), "image_id", "left_semi")
    return _sides(source, target, kept, p)


def combined_pairs(inputs: DataFrame, target: DataFrame, crops: DataFrame, p: int = PATCH) -> DataFrame:
    """(combo, image_id, crop_index, side, y, x, c, v) of inputs (combo, image_id, y, x, c, v): one pass over all inputs
    and one over the target, whose patches each combination of the same shape shares."""
    shape = ["image_id", "height", "width"]
    size = inputs.groupBy("combo", "image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    same = F.broadcast(size.join(dims(target), shape).select("combo", "image_id"))
    kept = materialize(within(crops, target, p), "crops")
    few = kept.count() <= FEW
    given = _cut(inputs.join(same, ["combo", "image_id"], "left_semi"), kept, p, "combo", few=few).withColumn("side", F.lit("input"))
    return given.unionByName(_cut(target, kept, p, few=few).join(same, "image_id").withColumn("side", F.lit("target")))


def built_pairs(source: DataFrame, target: DataFrame, mask: DataFrame, p: int = PATCH, crops: int = CROPS, seed: int = SEED, retries: int = RETRIES, defect_ratio: float | None = None, least: int = MIN_DEFECTS) -> DataFrame:
    """A builder of one degradation: images of source, target and mask of one shape, crops whose input passes the quality
    gate (a manifest for all degradations looks at the clean side instead), both sides cut and turned alike. With a
    defect_ratio (defective to corrected frames) that share of the crops is drawn where the sides differ."""
    skipped = shape_rejects(source, p, target=target, mask=mask)
    usable = source.join(skipped, "image_id", "left_anti")
    if defect_ratio is None:
        return _sides(source, target, crop_manifest(usable, mask, p, crops, seed, retries), p)
    drawn = defect_biased_crops(usable, difference(usable, target), mask, p, crops, seed, retries, defect_ratio, least)
    return _sides(source, target, drawn.drop("from_rich"), p)
