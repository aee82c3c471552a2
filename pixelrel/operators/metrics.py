"""Scores, training histories, noise schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from . import numbering

COSINE_SHIFT, BETA_MIN, BETA_MAX, SEED = 0.008, 1e-4, 0.9999, 42
#: Steps of a block of an average, decimal digits that powers of beta may span in it, and those that a double can tell.
BLOCK, DIGITS, SMALLEST = 256, 200, 17


def mse_psnr(a: DataFrame, b: DataFrame, peak: float = 1.0, *by: str) -> DataFrame:
    """(by..., mse, psnr) of aligned pixels; psnr is null for equal frames."""
    keys = ["image_id", "y", "x", "c"]
    d = F.col("v") - F.col("other")
    both = a.join(b.select(*keys, F.col("v").alias("other")), keys).groupBy(*(by or ("image_id",))).agg(F.avg(d * d).alias("mse"))
    return both.withColumn("psnr", F.when(F.col("mse") > 0, F.log10(F.lit(peak * peak) / F.col("mse")) * 10))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """(run, epoch, split, loss): the mean of batch means, so a short last batch weighs as a full one."""
    means = batches.groupBy("run", "epoch", "split", "batch").agg(F.avg("loss").alias("loss"))
    return means.groupBy("run", "epoch", "split").agg(F.avg("loss").alias("loss"))


def best_so_far(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds best (the smallest value before) and improved (strictly below it; the first always)."""
    before = F.min(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("best", before).withColumn("improved", F.col("best").isNull() | (F.col(value) < F.col("best")))


def ema(steps: DataFrame, by: list[str], order: str, value: str, beta: float = 0.999) -> DataFrame:
    """Adds ema: e_0 = v_0, e_t = beta e_(t-1) + (1 - beta) v_t, for 0 < beta < 1. Steps are numbered and cut into blocks in
    which powers of beta stay in range. A block's own average is a running sum; what came before it is an average of the
    averages of as many earlier blocks as a double can tell. No task holds a whole run."""
    size = max(1, min(BLOCK, int(DIGITS / -math.log10(beta))))
    far = max(1, math.ceil(SMALLEST / -math.log10(beta) / size))
    keyed = numbering.numbered(steps.select(*by, order, F.col(value).cast("double").alias(value)), [order], by, name="_t")
    cut = keyed.withColumn("_b", F.floor(F.col("_t") / size)).withColumn("_i", F.col("_t") % size)
    share = F.when(F.col("_t") == 0, 1.0).otherwise(1 - beta)
    inside = Window.partitionBy(*by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.col(value) * share * F.pow(F.lit(beta), -F.col("_i"))).over(inside) * F.pow(F.lit(beta), F.col("_i"))
    local = cut.withColumn("_own", own)
    ends = local.groupBy(*by, "_b").agg(F.max_by("_own", "_i").alias("_end"))
    earlier = F.collect_list("_end").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(-far, -1))  # full blocks
    carried = ends.select(*by, "_b", F.aggregate(earlier, F.lit(0.0), lambda e, v: e * beta**size + v).alias("_carried"))
    joined = local.join(carried, [*by, "_b"])
    return joined.select(*by, order, value, (F.col("_own") + F.col("_carried") * F.pow(F.lit(beta), F.col("_i") + 1)).alias("ema"))


def last_ema(steps: DataFrame, by: list[str], order: str, value: str, beta: float = 0.999) -> DataFrame:
    """(by..., ema) after the last step, as a weighted sum without a fold: v_0 weighs beta^(n-1), v_t (1 - beta) beta^(n-1-t)."""
    w = Window.partitionBy(*by)
    t, n = F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w)
    weight = F.pow(F.lit(beta), F.col("n") - 1 - F.col("t")) * F.when(F.col("t") == 0, 1.0).otherwise(1 - beta)
    return steps.withColumns({"t": t, "n": n}).groupBy(*by).agg(F.sum(F.col(value) * weight).alias("ema"))


def keep_last(files: DataFrame, by: list[str], order: str, n: int = 2) -> DataFrame:
    """Adds rank (1 is the newest) and keep."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return files.withColumn("rank", rank).withColumn("keep", F.col("rank") <= n)


def checkpoint_epoch(name: Column) -> Column:
    """The number before the suffix of a name such as a_b_12.pt; null without one."""
    return F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("int")


def zscores(scores: DataFrame, folder: str, candidate: str, value: str) -> DataFrame:
    """(folder, candidate, z): value against its folder, by the population deviation; 0 where the folder has none."""
    w = Window.partitionBy(folder)
    sd = F.stddev_pop(value).over(w)
    return scores.select(folder, candidate, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0).alias("z"))


def candidate_scores(z: DataFrame, candidate: str) -> DataFrame:
    return z.groupBy(candidate).agg(F.avg("z").alias("score"))


def two_stage_top(scores: DataFrame, folder: str, candidate: str, value: str, first: int, last: int) -> DataFrame:
    """The last best of the first best candidates, scored anew among themselves (lower is better)."""
    stage1 = candidate_scores(zscores(scores, folder, candidate, value), candidate).orderBy("score", candidate).limit(first)
    again = scores.join(stage1.select(candidate), candidate, "left_semi")
    return candidate_scores(zscores(again, folder, candidate, value), candidate).orderBy("score", candidate).limit(last)


def noise_schedule(spark: SparkSession, steps: int = 200) -> DataFrame:
    """(t, beta, alpha_bar, alpha_bar_prev, posterior_variance) of the cosine schedule, t from 0."""
    half_pi = math.pi / 2
    f = lambda t: F.pow(F.cos((t / steps + COSINE_SHIFT) / (1 + COSINE_SHIFT) * half_pi), 2)
    t = F.col("id")
    beta = F.greatest(F.lit(BETA_MIN), F.least(F.lit(BETA_MAX), 1 - f(t + 1) / f(t)))
    all_ = Window.orderBy("t")  # a row a step
    rows = spark.range(steps).select(t.cast("int").alias("t"), beta.alias("beta"))
    rows = rows.withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(all_.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(all_))
    return rows.withColumn("posterior_variance", F.col("beta") * (1 - F.col("alpha_bar_prev")) / (1 - F.col("alpha_bar")))


def forward_noise(values: DataFrame, schedule: DataFrame, value: str, noise: str) -> DataFrame:
    """Adds noisy and the v-target for each row's t: sqrt(ab) v + sqrt(1-ab) e, and sqrt(ab) e - sqrt(1-ab) v."""
    a, b = F.sqrt("alpha_bar"), F.sqrt(1 - F.col("alpha_bar"))
    joined = values.join(schedule.select("t", "alpha_bar"), "t")
    return joined.withColumn("noisy", a * F.col(value) + b * F.col(noise)).withColumn("v_target", a * F.col(noise) - b * F.col(value))


def drawn_noise(pixels: DataFrame, steps: int = 200, seed: int = SEED) -> DataFrame:
    """Adds t, an image's step, and noise, a pixel's standard normal variable: drawn by hash of their own keys, so they
    are the same for every run and partitioning."""
    at = ["image_id", "y", "x", "c"]
    noise = rng.normal(rng.key(seed, "noise", *at), rng.key(seed, "turn", *at))
    return pixels.withColumn("t", rng.choice(rng.key(seed, "step", "image_id"), F.lit(steps)).cast("int")).withColumn("noise", noise)
