"""Structured Streaming into panes: each micro-batch is one ingest, repeated batches do nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidepane.sources.samples import SCHEMA
from tidepane.streaming.ingest import Ingestion


def start(samples: DataFrame, ingestion: Ingestion, checkpoint: str, now_ms: int | None = None, once: bool = False) -> StreamingQuery:
    """Stream a streaming sample table into ``ingestion``.

    The source bounds a micro-batch (``maxFilesPerTrigger`` and the like), which
    is the back-pressure. With ``once`` all that is there is processed and the
    query ends.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        ingestion.ingest(batch, now_ms, batch_id)

    writer = samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sample_stream(spark, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming sample table of Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
