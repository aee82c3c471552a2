"""Tables that are added to once a key: a ledger of keys beside the data, and batches that count only once committed.

A folder holds data/ (partitioned by batch and by columns of the caller), keys/ (partitioned by a hash bucket of the key,
then by batch) and commits/ (a row a batch, written last). Readers see committed batches only, so a run that broke off
left nothing, and a run that is repeated adds nothing. New rows are held against the ledger's buckets that they fall
into, not against all that was ever written. One writer at a time; keys must not be null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, exists

BUCKETS = 256
COMMIT = "batch string, given long, written long"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of each committed batch: keys that were given, and keys that were new."""
    there = exists(spark, f"{folder}/commits")
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits") if there else spark.createDataFrame([], COMMIT)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What committed batches have written."""
    return spark.read.parquet(f"{folder}/data").join(commits(spark, folder).select("batch"), "batch", "left_semi").drop("batch")


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))


def unseen(given: DataFrame, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The distinct keys of given that no committed batch holds."""
    spark, wanted = given.sparkSession, _bucketed(given.select(*keys).distinct(), keys, buckets)
    if not exists(spark, f"{folder}/commits"):
        return wanted.drop("bucket")
    held = spark.read.parquet(f"{folder}/keys")
    asked = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())  # BUCKETS numbers at most
    done = held.where(F.col("bucket").isin(asked)).join(commits(spark, folder).select("batch"), "batch", "left_semi")
    return wanted.join(done.select(*keys), [*keys], "left_anti").drop("bucket")


def append(given: DataFrame, folder: str, keys: Sequence[str], stage: Callable[[DataFrame], DataFrame] = lambda rows: rows, by: Sequence[str] = (), buckets: int = BUCKETS) -> dict[str, int]:
    """Writes stage(rows of given whose keys are new), partitioned by the columns by; returns the batch's counters."""
    spark, batch = given.sparkSession, uuid.uuid4().hex
    with Scratch(spark) as scratch:
        seen, new = Observation("given"), Observation("written")
        counted = given.select(*keys).distinct().observe(seen, F.count("*").alias("n"))
        todo = scratch.table(unseen(scratch.table(counted, "given"), folder, keys, buckets).observe(new, F.count("*").alias("n")), "todo")
        found = {"given": seen.get["n"], "written": new.get["n"]}
        if not found["written"]:
            return found
        made = stage(given.join(todo, [*keys], "left_semi"))
        made.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", *by).parquet(f"{folder}/data")
        _bucketed(todo, keys, buckets).withColumn("batch", F.lit(batch)).repartition("bucket").write.mode("append").partitionBy("bucket", "batch").parquet(f"{folder}/keys")
        spark.createDataFrame([(batch, found["given"], found["written"])], COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
        return found
