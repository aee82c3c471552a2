"""Files as they arrive: a stream of batches, each handled as a table; finished ones are skipped when it starts anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import ledger


def arrivals(spark: SparkSession, folder: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A streaming table over a folder that gets more files."""
    return spark.readStream.schema(schema).format(kind).load(folder)


def process(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "image_id") -> StreamingQuery:
    """Applies stage to what arrives and adds it to out, a folder that ledger.read() reads. Keys that out holds already
    are left out, so a batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        ledger.append(df, out, [key], stage)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
