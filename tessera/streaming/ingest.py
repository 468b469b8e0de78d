"""Structured Streaming around the index: each micro-batch is indexed as a whole, and running it twice changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.store import Current
from tessera.plans.index import Indexer


def index_stream(source: DataFrame, base: str, indexer: Indexer, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Indexes a stream of documents into the tables below `base`; what is there now is read, then the query ends.

    The number of the stream's last batch is part of the pointer to the tables' versions, so after a restart a batch that was
    already applied is left out, and one that wasn't finds the tables as they were.
    """

    def batch(rows: DataFrame, number: int) -> None:
        now = Current.read(rows.sparkSession, base)
        if number > now.batches.get(checkpoint, -1):
            _, docs, chunks = indexer.run(rows, now.documents, now.chunks)
            now.replace(docs, chunks, **{checkpoint: number})
        if after:
            after(number)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
