"""Running sums and row numbers in two levels: inside of a block, and over the totals of the blocks before it.

A window over a whole relation, or over one large group of it, is one task. Here rows are cut into blocks along the
order; only the blocks' totals are summed over the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .joins import shuffled


def in_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with _block, an int that never falls along the keys: range partitions, as many as Spark shuffles to, so a
    large group is spread too. Written once, since another execution may draw other bounds."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(parts, *keys).withColumn("_block", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), block: Column | None = None, **values: Column) -> DataFrame:
    """Adds, under each name, the sum of its values over the rows of the same group up to a row, itself included. by must
    hold no nulls. block is an expression that never falls along the order, so that no write is needed; without one the
    rows are dealt out by ranges. Rows that are equal in order come in any order, but never in two blocks."""
    by, order = [*by], [*order]
    cut = in_ranges(rows, *by, *order) if block is None else rows.withColumn("_block", block)
    totals = cut.groupBy(*by, "_block").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in values])
    # the window below asks for the same shuffle; ranges are as few as Spark's shuffle partitions
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.join(offsets if block is None else shuffled(offsets), [*by, "_block"]).withColumns({k: F.sum(v).over(inside) + F.col(f"_before_{k}") for k, v in values.items()})
    return summed.drop("_block", *[f"_before_{k}" for k in values])


def numbered(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), block: Column | None = None, name: str = "k") -> DataFrame:
    """Adds the rows' number in their group, from 0."""
    return running(rows, order, by, block, **{name: F.lit(1)}).withColumn(name, F.col(name) - 1)
