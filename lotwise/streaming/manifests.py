"""An extension beyond batch: new manifest files as a stream, handled by the batch operators.

Each micro-batch is appended to the manifest as it is; keep-first over the whole manifest stays a batch view, so a batch
and a stream over the same files agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def append(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes everything that is there now, then ends; a later run goes on from its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
