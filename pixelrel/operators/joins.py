"""Joins of relations that grow with the pixels.

Spark broadcasts, through the driver, what it takes to be below spark.sql.autoBroadcastJoinThreshold, and it goes by
compressed bytes and by sizes before an explode. Coordinates compress to next to nothing, so that a few megabytes can be
millions of pixels, hundreds of megabytes in the driver. Such joins are hinted to shuffle both sides; what has a row an
image (and channel) is hinted to be broadcast, so that the pixels on the other side never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(rows: DataFrame) -> DataFrame:
    """rows as one side of a join that shuffles and sorts both, however small they seem."""
    return rows.hint("merge")
