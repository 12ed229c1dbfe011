"""Keeping the ``nodes`` table of a growing corpus up to date.

Files that arrive as a stream are parsed batch by batch; each batch becomes a
version folder of its own, written once whatever a restart repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from parenlake.operators.nodes import errors, nodes


def index_stream(sources: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse a streaming sources table into ``path``/nodes and ``path``/errors."""

    def write(batch: DataFrame, number: int) -> None:
        nodes(batch).write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        errors(batch).write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    return sources.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
