"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links to (node, component): the smallest node that can be reached.

    Contraction: in each round every label moves to its neighbour of smallest salted hash and on to that one's own,
    links are relabelled and loops dropped, so the number of links falls by a constant factor in two rounds whatever the
    ids are. A salt holds for two rounds: what the first leaves of a star, the second moves. What a round needs is written to the shared folder. Nodes without links aren't in the result.
    """
    live = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))

    def relabel(df: DataFrame, move: DataFrame, c: str) -> DataFrame:
        return df.join(move.withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")

    round_ = 0
    while not live.isEmpty():
        hash_of = lambda c, salt=1 + round_ // 2: F.xxhash64(c, F.lit(salt))
        round_ += 1
        both = live.union(live.select("b", "a"))
        best = both.groupBy("a").agg(F.min_by("b", hash_of("b")).alias("to"), F.min(hash_of("b")).alias("h"))
        move = best.where(F.col("h") < hash_of("a")).select("a", "to")
        move = materialize(_twice(move), "moves")
        live = relabel(relabel(live, move, "a"), move, "b").where("a <> b")
        live = materialize(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        labels = relabel(labels, move, "label").select("node", "label")
    labels = materialize(labels, "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def _twice(move: DataFrame) -> DataFrame:
    """(a, to) followed once more where to moves as well."""
    on = move.select(F.col("a").alias("to"), F.col("to").alias("further"))
    return move.join(on, "to", "left").select("a", F.coalesce("further", "to").alias("to"))
