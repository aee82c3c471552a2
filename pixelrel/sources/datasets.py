"""Training datasets on disk: patch pairs as a partitioned table, listings paired by stem, split manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import stem
from ..operators import numbering, splits
from ..storage import exists
from . import files, ledger

PATCH_KEYS = ["combo", "image_id", "crop_index"]
ROLES = ("train_input", "train_target", "val_input", "val_target")


def write_patches(patches: DataFrame, folder: str) -> dict[str, int]:
    """Adds patches (combo, image_id, crop_index, side, data) under data/batch=/combo=/side=, named <image>_<crop>; pairs
    that the folder holds already are left out. Returns how many pairs were given and how many were new."""
    named = patches.withColumn("name", F.format_string("%s_%04d", F.col("image_id"), F.col("crop_index")))
    return ledger.append(named, folder, PATCH_KEYS, by=["combo", "side"])


def read_patches(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.read(spark, folder)


def paired(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """(stem, input, target, issue) of two listings (path): paired by stem and not by position, so one missing file
    doesn't shift all that follow. issue: no input, no target, or duplicate (two files of one side share a stem)."""
    side = lambda df, name: df.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias(name), F.count("*").alias(f"n_{name}"))
    both = side(inputs, "input").join(side(targets, "target"), "stem", "full")
    twice = (F.coalesce("n_input", F.lit(0)) > 1) | (F.coalesce("n_target", F.lit(0)) > 1)
    issue = F.when(F.col("input").isNull(), "no input").when(F.col("target").isNull(), "no target").when(twice, "duplicate")
    return both.select("stem", "input", "target", issue.alias("issue"))


def dataset(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """(i, stem, input, target) in order of the stems; raises ValueError if files are left over, double or none at all."""
    pairs = paired(inputs, targets)
    found = pairs.agg(F.count("*").alias("n"), F.count("issue").alias("bad"), F.min(F.when(F.col("issue").isNotNull(), F.concat_ws(": ", "stem", "issue"))).alias("first")).first()
    if found.bad or not found.n:
        raise ValueError(f"{found.bad} of {found.n} stems don't pair, the first is {found.first}" if found.n else "no files")
    return numbering.numbered(pairs.drop("issue"), ["stem"], name="i")


def split(pairs: DataFrame, validation: float = splits.VALIDATION, seed: int = splits.SEED) -> DataFrame:
    """(path, role, side) of pairs (stem, input, target): an exact share of the stems is val."""
    roles = splits.exact_split(pairs.select("stem", "input", "target"), "stem", validation, seed)
    sides = F.explode(F.array(F.struct(F.lit("input").alias("side"), F.col("input").alias("path")), F.struct(F.lit("target").alias("side"), F.col("target").alias("path"))))
    return roles.select("role", sides.alias("s")).select("s.path", "role", "s.side")


def write_split(rows: DataFrame, folder: str) -> None:
    """The split manifest as JSON lines, each with one path and the list that it belongs to, so no task gathers a list."""
    rows.select(F.concat_ws("_", "role", "side").alias("list"), "path").write.mode("overwrite").json(folder)


def split_json(rows: DataFrame) -> DataFrame:
    """One row (value): the manifest as one object of four lists, as other tools read it. The lists meet in one row."""
    lists = [F.array_sort(F.collect_list(F.when(F.concat_ws("_", "role", "side") == name, F.col("path")))).alias(name) for name in ROLES]
    return rows.agg(F.to_json(F.struct(*lists)).alias("value"))


def read_split(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, role, side) of the first of the folders or files that exists, an output of a run before the input it was
    given; one object of lists or JSON lines. Raises ValueError if none exists or a list is missing."""
    for place in folders:
        if exists(spark, place):
            rows = _one_object(spark, place) if place.endswith(".json") else spark.read.schema("list string, path string").json(place)
            part = lambda i: F.split_part("list", F.lit("_"), F.lit(i))
            return rows.where(F.col("list").isin(*ROLES)).select("path", part(1).alias("role"), part(2).alias("side"))
    raise ValueError("no split manifest")


def _one_object(spark: SparkSession, place: str) -> DataFrame:
    text = spark.read.text(place, wholetext=True)
    lost = text.select(F.explode(files.keys_missing(F.col("value"), list(ROLES))).alias("k")).distinct()
    if names := sorted(r.k for r in lost.collect()):
        raise ValueError(f"{place} lacks {', '.join(names)}")
    lists = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("list", "paths"))
    return lists.select("list", F.explode("paths").alias("path"))
