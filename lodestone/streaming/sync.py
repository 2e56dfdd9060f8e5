"""Continuous ingestion, an extension: lines arrive as a stream, each micro-batch is a sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..service import Workbench


def follow(lines: DataFrame, bench: Workbench, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Syncs every micro-batch of a streaming `lines` table. A document's lines must arrive in one batch (one file).

    A batch that is run again finds its documents' hashes stored and reuses them, so a restart repeats nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            bench.sync(rows)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
