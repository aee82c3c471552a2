"""Star libraries on disk: a catalogue, stamps as arrays, and the densities of the fields they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stars of a partition of the stamps table.
STARS = 4_096


def packed(stamps: DataFrame) -> DataFrame:
    """(star_id, rgb array<float>, alpha array<float>): stamps (star_id, dy, dx, c, rgb, alpha) row by row, rgb with its
    channels last. A star's own pixels meet in a row, no more."""
    rows = F.array_sort(F.collect_list(F.struct("dy", "dx", "c", F.col("rgb").cast("float").alias("rgb"), F.col("alpha").cast("float").alias("alpha"))))
    whole = stamps.groupBy("star_id").agg(rows.alias("r"))
    return whole.select("star_id", F.transform("r", lambda r: r["rgb"]).alias("rgb"), F.transform(F.filter("r", lambda r: r["c"] == 0), lambda r: r["alpha"]).alias("alpha"))


def unpacked(packed_: DataFrame, stars: DataFrame) -> DataFrame:
    """The stamps (star_id, dy, dx, c, rgb, alpha) again; stars tells the widths."""
    sized = packed_.join(stars.select("star_id", "h", "w"), "star_id")
    flat = sized.select("star_id", "w", "alpha", (F.size("rgb") / (F.col("h") * F.col("w"))).cast("int").alias("n"), F.posexplode("rgb").alias("p", "rgb"))
    cell = F.expr("cast(p div n as int)")
    return flat.select("star_id", F.expr("cast(p div n div w as int)").alias("dy"), (cell % F.col("w")).alias("dx"), (F.col("p") % F.col("n")).alias("c"), F.col("rgb").cast("double").alias("rgb"), F.get("alpha", cell).cast("double").alias("alpha"))


def write_library(stars: DataFrame, stamps: DataFrame, densities: DataFrame, folder: str) -> None:
    """metadata/ (JSON lines: star_id, file, h, w, peak, flux, source), stamps/ (Parquet, dealt by star_id) and
    field_density/ (JSON lines: source, density)."""
    part = F.expr(f"star_id div {STARS}")
    name = F.format_string("star_%06d.npz", F.col("star_id"))
    stars.select("star_id", name.alias("file"), "h", "w", "peak", "flux", "source").write.mode("overwrite").json(f"{folder}/metadata")
    packed(stamps).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/stamps")
    densities.select("source", "density").write.mode("overwrite").json(f"{folder}/field_density")


def read_library(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stars, stamps, densities) as write_library() got them; raises ValueError if there is no star."""
    stars = spark.read.schema("star_id long, file string, h int, w int, peak double, flux double, source string").json(f"{folder}/metadata")
    if stars.isEmpty():
        raise ValueError(f"empty library in {folder}")
    held = spark.read.parquet(f"{folder}/stamps").select("star_id", "rgb", "alpha")
    return stars, unpacked(held, stars), spark.read.schema("source string, density double").json(f"{folder}/field_density")
