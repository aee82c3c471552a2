"""Model merging over task vectors (task, param, idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from .quantiles import quantiles

KEEP, DROP, SCALE = 0.2, 0.9, 1.0


def task_arithmetic(vectors: DataFrame, weights: dict[str, float] | None = None, scale: float = SCALE) -> DataFrame:
    """(param, idx, value): the scaled sum of task vectors."""
    w = F.lit(1.0)
    for task, x in (weights or {}).items():
        w = F.when(F.col("task") == task, F.lit(x)).otherwise(w)
    return vectors.groupBy("param", "idx").agg((F.sum(F.col("value") * w) * scale).alias("value"))


def trim(vectors: DataFrame, keep: float = KEEP) -> DataFrame:
    """The share keep of largest magnitudes of each task, by the exact quantile (ties at it stay)."""
    cut = quantiles(vectors, ["task"], F.abs("value"), [1 - keep]).select("task", F.col("p")[0].alias("cut"))
    return vectors.join(cut, "task").where(F.abs("value") >= F.col("cut")).drop("cut")


def elect_and_mean(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """The sign of the sum wins; the mean of the values that agree with it (0 if the sum is 0)."""
    sign = vectors.groupBy("param", "idx").agg(F.sign(F.sum("value")).alias("sign"))
    joined = vectors.join(sign, ["param", "idx"]).where((F.sign("value") == F.col("sign")) & (F.col("sign") != 0))
    return joined.groupBy("param", "idx").agg((F.avg("value") * scale).alias("value"))


def ties(vectors: DataFrame, keep: float = KEEP, scale: float = SCALE) -> DataFrame:
    return elect_and_mean(trim(vectors, keep), scale)


def dare(vectors: DataFrame, drop: float = DROP, seed: int = 42) -> DataFrame:
    """Drops coordinates by hash and rescales the rest by 1 / (1 - drop)."""
    kept = vectors.where(~rng.bernoulli(rng.key(seed, "dare", "task", "param", "idx"), drop))
    return kept.withColumn("value", F.col("value") / (1 - drop))


def dare_ties(vectors: DataFrame, drop: float = DROP, keep: float = KEEP, seed: int = 42, scale: float = SCALE) -> DataFrame:
    return ties(dare(vectors, drop, seed), keep, scale)


def cosine(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of each pair of tasks."""
    norm = vectors.groupBy("task").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    a = vectors.select("param", "idx", F.col("task").alias("a"), F.col("value").alias("va"))
    b = vectors.select("param", "idx", F.col("task").alias("b"), F.col("value").alias("vb"))
    dot = a.join(b, ["param", "idx"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    named = lambda c: norm.select(F.col("task").alias(c), F.col("norm").alias(f"n{c}"))
    return dot.join(named("a"), "a").join(named("b"), "b").select("a", "b", (F.col("dot") / F.col("na") / F.col("nb")).alias("cosine"))


def without_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Strips a prefix off the keys if all of them have it, else none."""
    every = rows.agg(F.min(F.col(key).startswith(prefix)).alias("every"))  # one row
    stripped = F.when(F.col("every"), F.substr(F.col(key), F.lit(len(prefix) + 1))).otherwise(F.col(key))
    return rows.crossJoin(every).withColumn(key, stripped).drop("every")
