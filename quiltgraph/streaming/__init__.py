"""Ingestion of growing node and edge tables.

Streams are not part of the query language. This module only lets a table of a graph
be fed by one: each micro-batch becomes part of a stored table, and queries read it as
they would any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_to(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Appends a stream to a Parquet table, each row of a micro-batch once by ``keys``; runs to the end of what is there.

    A batch writes to a folder of its own number, so a batch that is run again after a
    failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys) if keys else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
