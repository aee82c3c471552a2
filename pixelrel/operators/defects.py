"""Hot and dead pixels: local median, robust sigma, flags, correction, and transplanting defects onto other frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import dims
from ..storage import materialize
from .joins import shuffled
from .quantiles import quantiles
from .stencil import dilate, local_median

MAD, SIGMA, SIZE, EPS = 1.4826, 6.0, 5, 1e-6
AT = ["image_id", "y", "x"]


def residuals(pixels: DataFrame, mask: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """(image_id, y, x, c, v, med, res, valid); without a mask, or where it has no row, a pixel is valid."""
    found = local_median(pixels, size).withColumn("res", F.col("v") - F.col("med"))
    if mask is None:
        return found.withColumn("valid", F.lit(True))
    return found.join(shuffled(mask.select(*AT, "valid")), AT, "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


def robust_sigma(res: DataFrame) -> DataFrame:
    """(image_id, c, sigma): 1.4826 x the median distance to the median over valid pixels; 0 without any."""
    by, valid = ["image_id", "c"], res.where("valid")
    mid = quantiles(valid, by, F.col("res"), [0.5]).select(*by, F.col("p")[0].alias("mid"))
    mad = quantiles(valid.join(F.broadcast(mid), by), by, F.abs(F.col("res") - F.col("mid")), [0.5]).select(*by, F.col("p")[0].alias("mad"))
    return res.select(*by).distinct().join(mad, by, "left").select(*by, F.coalesce(F.col("mad") * MAD, F.lit(0.0)).alias("sigma"))


def flags(res: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """res with bad: a valid pixel further than sigma robust sigmas from its local median; none where sigma is 0."""
    bad = F.col("valid") & (F.col("sigma") > 0) & (F.abs("res") > F.col("sigma") * sigma)
    return res.join(F.broadcast(robust_sigma(res)), ["image_id", "c"]).withColumn("bad", bad)


def detect(pixels: DataFrame, mask: DataFrame | None = None, sigma: float = SIGMA, grow: int = 0, size: int = SIZE) -> DataFrame:
    """(image_id, y, x, c, v, med, bad) with the flags grown by a cross grow times (not cut back to valid pixels)."""
    found = flags(materialize(residuals(pixels, mask, size), "residuals"), sigma)  # read five times
    if grow > 0:
        grown = dilate(found.where("bad"), grow, dims(pixels)).withColumn("grown", F.lit(True))
        found = found.join(shuffled(grown), [*AT, "c"], "left").withColumn("bad", F.coalesce("grown", F.lit(False)))
    return found.select(*AT, "c", "v", "med", "bad")


def correct(found: DataFrame) -> DataFrame:
    """Flagged channel values become the local median."""
    return found.select(*AT, "c", F.expr("if(bad, med, v)").alias("v"))


def counts(found: DataFrame) -> DataFrame:
    """(image_id, n_bad, bad_pct): pixels with a flag in any channel."""
    union = found.groupBy(*AT).agg(F.bool_or("bad").alias("bad"))
    return union.groupBy("image_id").agg(F.count_if("bad").alias("n_bad"), (F.avg(F.col("bad").cast("int")) * 100).alias("bad_pct"))


def difference(a: DataFrame, b: DataFrame, eps: float = EPS) -> DataFrame:
    """(image_id, y, x) where two aligned frames differ by more than eps, summed over channels."""
    both = a.select(*AT, "c", F.col("v").alias("va")).join(shuffled(b.select(*AT, "c", F.col("v").alias("vb"))), [*AT, "c"])
    return both.groupBy(*AT).agg(F.sum(F.abs(F.col("va") - F.col("vb"))).alias("d")).where(F.col("d") > eps).select(*AT)


def delta(original: DataFrame, corrected: DataFrame, eps: float = EPS) -> DataFrame:
    """(image_id, y, x, c, o, k, bad): both frames' values, and whether they differ there by more than eps, summed over
    channels."""
    keys = [*AT, "c"]
    both = original.select(*keys, F.col("v").alias("o")).join(shuffled(corrected.select(*keys, F.col("v").alias("k"))), keys)
    return both.withColumn("bad", F.sum(F.abs(F.col("o") - F.col("k"))).over(Window.partitionBy(*AT)) > eps)


def transplant(composite: DataFrame, original: DataFrame, corrected: DataFrame, mode: str = "replace", eps: float = EPS, moved: DataFrame | None = None) -> DataFrame:
    """Puts the original's defects onto a composite, all channels of a differing pixel. replace takes the original's value;
    additive adds original - corrected, unclipped. Images whose three frames aren't of one shape are left out. moved is
    the delta of the two frames, where it is written already."""
    keys = [*AT, "c"]
    shape = ["image_id", "height", "width"]
    alike = dims(composite).join(dims(original), shape).join(dims(corrected), shape).select("image_id")
    kept = composite.join(F.broadcast(alike), "image_id", "left_semi").select(*keys, "v")
    value = F.col("o") if mode == "replace" else F.col("v") + F.col("o") - F.col("k")
    base = kept.join(shuffled(delta(original, corrected, eps) if moved is None else moved), keys)
    return base.select(*keys, F.when(F.col("bad"), value).otherwise(F.col("v")).alias("v"))
