"""Train and validation splits, their audits, and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from . import numbering

VALIDATION, SEED, BUCKETS = 0.1, 42, 1024


def exact_split(rows: DataFrame, key: str, validation: float = VALIDATION, seed: int = SEED) -> DataFrame:
    """Adds role: exactly floor(validation x n) rows are val, those of smallest hash. Ranks are counted in hash buckets and
    offset by the buckets before, so no window spans all rows."""
    keyed = rows.withColumn("k", rng.key(seed, "split", key)).withColumn("bucket", F.floor(F.col("k") / ((1 << 32) // BUCKETS)))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("m"))
    before = sizes.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))  # BUCKETS rows
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("k", key)) + F.col("before")
    ranked = keyed.join(before, "bucket").withColumn("rank", rank)
    return ranked.withColumn("role", F.when(F.col("rank") <= F.floor(F.col("n") * validation), "val").otherwise("train")).drop("k", "bucket", "before", "n", "rank")


def leakage(train: DataFrame, val: DataFrame, key: str) -> DataFrame:
    """Keys in both roles."""
    return train.select(key).intersect(val.select(key))


def unaccounted(manifest: DataFrame, *sources: DataFrame, key: str) -> DataFrame:
    """Keys of the manifest that no source holds."""
    out = manifest.select(key).distinct()
    for source in sources:
        out = out.join(source.select(key).distinct(), key, "left_anti")
    return out


def attributed(manifest: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, source) for each source that holds a key of the manifest."""
    parts = [manifest.select(key).distinct().join(s.select(key).distinct(), key, "left_semi").withColumn("source", F.lit(name)) for name, s in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pending(inputs: DataFrame, *outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that miss at least one of the outputs."""
    missing = [inputs.join(o.select(key).distinct(), key, "left_anti") for o in outputs]
    out = missing[0]
    for part in missing[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates([key])


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def preferred(files: DataFrame, stem: str, suffix: str, order: list[str]) -> DataFrame:
    """One file a stem: that of the suffix named first; suffixes not named don't count."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(suffix))
    best = Window.partitionBy(stem).orderBy("rank", *[c for c in files.columns if c not in (stem, suffix)])
    return files.withColumn("rank", rank).where(F.col("rank") > 0).withColumn("n", F.row_number().over(best)).where(F.col("n") == 1).drop("rank", "n")


def composites(files: DataFrame, stem: str, suffix: str) -> DataFrame:
    """The listing of composites: NPY files, then TIF files, so the TIF of a stem that has both is what stays."""
    return preferred(files, stem, suffix, ["tif", "npy"])


def wrapped(files: DataFrame, indices: DataFrame, order: str) -> DataFrame:
    """(i, ...) the file at each index modulo the number of files, in order: a fixed preview set."""
    listed = numbering.numbered(files, [order], name="_k")
    asked = indices.withColumn("_k", F.pmod(F.col("i"), F.lit(max(1, files.count()))))
    return asked.join(listed, "_k").drop("_k")
