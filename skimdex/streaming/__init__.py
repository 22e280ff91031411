"""Index upkeep for tables that streams append to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, refresh: bool = True, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch to ``table`` and, with ``refresh``, builds its indexes over the new files."""

    def land(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.write(batch, mode="append")
            if refresh:
                table.engine.refresh_index(table)

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
