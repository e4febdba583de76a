"""A stream of operations into a table, a commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..table import Table


def start(stream: DataFrame, table: Table, name: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append (op, key, value, and ord if keys repeat in a batch) of ``stream``.

    The manifest records the last micro-batch of ``name`` in the same commit as its rows, so a batch that Spark
    replays after a failure is applied once.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        table.refresh()
        table.apply(batch, (name, batch_id))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
