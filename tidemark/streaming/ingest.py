"""Structured Streaming into a versioned table: one run per micro-batch, each exactly once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.table import Table


def ingest(
    stream: DataFrame, table: Table, name: str, checkpoint: str, tombstone: Column | None = None, compact: bool = False, order_by: Column | Sequence[Column] | None = None, **trigger
) -> StreamingQuery:
    """Append a stream of keys and values; rows with a true ``tombstone`` are deletes.

    Of several rows of one key in a micro-batch the one with the largest ``order_by`` wins.

    The commit of a batch records the stream's name and the batch's number, so a batch that is run
    again after a failure is recognised and skipped. ``trigger`` goes to ``DataStreamWriter.trigger``.
    """

    def write(batch: DataFrame, number: int) -> None:
        if table.state().batches.get(name, -1) >= number:
            return
        table.write(batch, tombstone, info={"stream": name, "batch": number}, order_by=order_by)
        if compact:
            table.compact()

    to = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (to.trigger(**trigger) if trigger else to).start()
