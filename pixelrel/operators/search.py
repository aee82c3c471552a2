"""Two-stage search for merge weights over a grid, by inner products instead of merged models.

A merge is a weighted sum of task vectors, so its squared distance to any other weighted sum is a quadratic form of their
inner products. Those are made in one pass over the vectors; each point of the grid then costs a few multiplications,
whatever a model's size, and only the best point is merged in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merging, metrics

KEEP = 8


def gram(vectors: DataFrame) -> tuple[list[str], list[list[float]], int]:
    """The names of the tasks, the inner products of their vectors (task, param, idx, value), and the number of
    coordinates. Tasks become columns, so a coordinate is one row; meant for tens of tasks. A vector is 0 where it has no row."""
    names = sorted(r.task for r in vectors.select("task").distinct().collect())
    wide = vectors.groupBy("param", "idx").pivot("task", names).agg(F.sum("value")).toDF("param", "idx", *[f"t{i}" for i in range(len(names))]).na.fill(0.0)
    products = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"p{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    row = wide.agg(F.count("*").alias("n"), *products).first()
    return names, [[row[f"p{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))], row.n


def grid(spark: SparkSession, tasks: int, values: Sequence[float]) -> DataFrame:
    """(candidate long, weights array<double>): every choice of one of the values for each task."""
    digit = lambda i: F.expr(f"cast(id div {len(values) ** i} % {len(values)} as int)")
    choices = F.array(*[F.lit(float(v)) for v in values])
    return spark.range(len(values) ** tasks).select(F.col("id").alias("candidate"), F.array(*[F.get(choices, digit(i)) for i in range(tasks)]).alias("weights"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def folders(tasks: int, size: int) -> list[list[float]]:
    """What the merge should equal on each folder: the sum of the vectors of every choice of so many tasks."""
    return [[float(i in some) for i in range(tasks)] for some in combinations(range(tasks), size)]


def distances(candidates: DataFrame, targets: Sequence[Sequence[float]], products: Sequence[Sequence[float]], n: int) -> DataFrame:
    """(folder int, candidate, score): the mean squared difference of each candidate's merge to each target."""
    row = lambda values: F.array(*[F.lit(float(v)) for v in values])
    each = candidates.select("candidate", "weights", F.posexplode(F.array(*map(row, targets))).alias("folder", "target"))
    off = each.select("folder", "candidate", F.zip_with("weights", "target", lambda w, t: w - t).alias("off"))
    turned = F.array(*[_dot(row(p), F.col("off")) for p in products])
    return off.select("folder", "candidate", (_dot(F.col("off"), turned) / F.lit(float(n))).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    """(candidate, score): the mean of the folders' z-scores, lower is better."""
    return metrics.candidate_scores(metrics.zscores(scored, "folder", "candidate", "score"), "candidate")


def best_weights(vectors: DataFrame, values: Sequence[float], keep: int = KEEP) -> tuple[DataFrame, list[str]]:
    """(candidate, weights, stage_one, score), best first, and the names of the tasks: stage one ranks the whole grid on
    folders of one task and keeps the first; stage two ranks those anew on folders of two tasks. Ties go to the smaller
    candidate."""
    names, products, n = gram(vectors)
    points = grid(vectors.sparkSession, len(names), values)
    first = ranked(distances(points, folders(len(names), 1), products, n)).withColumnRenamed("score", "stage_one").orderBy("stage_one", "candidate").limit(keep)
    left = points.join(first, "candidate")
    if len(names) < 2:
        return left.withColumn("score", F.col("stage_one")).orderBy("score", "candidate"), names
    second = ranked(distances(left, folders(len(names), 2), products, n))
    return left.join(second, "candidate").orderBy("score", "candidate"), names


def merge_best(vectors: DataFrame, values: Sequence[float], keep: int = KEEP) -> DataFrame:
    """(param, idx, value): the merge by the best weights, the only one that is made."""
    found, names = best_weights(vectors, values, keep)
    return merging.task_arithmetic(vectors, dict(zip(names, found.first().weights)))
