"""Exact quantiles by group in two passes, so that no aggregate holds a group's values.

The first pass counts values by bucket; buckets are cut on a logarithmic scale, so an outlier doesn't make them coarse.
The running counts tell which one or two buckets hold the wanted ranks; the second pass sorts what is in those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets for each doubling of a value (each holds no more than 2 ** 17 different single-precision values), and a number
#: above all bucket numbers of finite values.
PER_OCTAVE, TOP = 64, 1 << 18


def bucket(v: Column) -> Column:
    """A bucket number that never falls as v rises; NaN comes last, as Spark sorts it."""
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + TOP // 2  # a double's octaves lie between -1074 and 1024
    finite = F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), TOP + 1).when(v == float("inf"), TOP).when(v == float("-inf"), -TOP).otherwise(finite).cast("int")


def quantiles(rows: DataFrame, by: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """(by..., p array<double>): for each share of 0 to 1 the quantile with linear interpolation between ranks. Nulls
    don't count; groups without a value have no row. Reads rows twice: write them first if they are dear."""
    by = [*by]
    keyed = rows.select(*by, value.cast("double").alias("_v")).where("_v is not null").withColumn("_b", bucket(F.col("_v")))
    group, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    placed = counts.select(*by, "_b", "_n", F.sum("_n").over(upto).alias("_to"), (F.sum("_n").over(group) - 1).alias("_last"))
    at = lambda share: F.col("_last") * F.lit(float(share))
    ranks = [F.struct(F.lit(i).alias("i"), (F.floor(at(s)) + up).alias("rank"), (at(s) - F.floor(at(s))).alias("part"), F.lit(up).alias("up")) for i, s in enumerate(shares) for up in (0, 1)]
    here = lambda r: (r["rank"] < F.col("_to")) & (r["rank"] >= F.col("_to") - F.col("_n")) & ((r["up"] == 0) | (r["part"] > 0))
    asked = placed.select(*by, "_b", (F.col("_to") - F.col("_n")).alias("_from"), F.filter(F.array(*ranks), here).alias("_r")).where(F.size("_r") > 0)
    # at most two rows a group and share are asked for
    within = keyed.join(F.broadcast(asked), [*by, "_b"]).groupBy(*by, "_b", "_v").agg(F.count("*").alias("_n"), F.first("_from").alias("_from"), F.first("_r").alias("_r"))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ended = within.withColumn("_end", F.sum("_n").over(inside) + F.col("_from"))
    hits = ended.select(*by, "_v", F.explode(F.filter("_r", lambda r: (r["rank"] < F.col("_end")) & (r["rank"] >= F.col("_end") - F.col("_n")))).alias("_r"))
    each = [F.min(F.when(F.col("_r.i") == i, F.struct(F.col("_r.rank").alias("rank"), F.col("_v").alias("v"), F.col("_r.part").alias("part")))).alias(f"_lo{i}") for i in range(len(shares))]
    each += [F.max(F.when(F.col("_r.i") == i, F.struct(F.col("_r.rank").alias("rank"), F.col("_v").alias("v")))).alias(f"_hi{i}") for i in range(len(shares))]
    between = [F.when(F.col(f"_lo{i}.v") == F.col(f"_hi{i}.v"), F.col(f"_lo{i}.v")).otherwise(F.col(f"_lo{i}.v") + (F.col(f"_hi{i}.v") - F.col(f"_lo{i}.v")) * F.col(f"_lo{i}.part")) for i in range(len(shares))]
    return hits.groupBy(*by).agg(*each).select(*by, F.array(*between).alias("p"))

