"""Pages that arrive as files. An extension: the page operators run on each micro-batch of whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import verify


def verify_stream(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Verify the lines available now and write them as Parquet, a folder for each batch: a batch that is run again after
    a failure overwrites its own folder. A page's lines must arrive together, since rules look at the whole page."""

    def write(batch: DataFrame, number: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
