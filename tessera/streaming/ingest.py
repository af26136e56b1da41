"""Incremental ingest: each micro-batch is an idempotent upsert keyed on doc_id; statistics are derived when read, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import from_rows_chunked
from ..operators.store import Engine


def ingest_stream(rows: DataFrame, engine: Engine, id_col: str, text_col: str, chunker, checkpoint: str, once: bool = True) -> StreamingQuery:
    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            engine.upsert(from_rows_chunked(batch, id_col, text_col, chunker))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
