"""Incremental append of result rows: the stream's batch id takes the place of a lock file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_results(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving result rows to ``path`` once each.

    A batch writes its own folder and overwrites it on a retry, so a lost executor or a restarted driver neither
    drops nor doubles rows. Read everything back with ``spark.read.parquet(path)``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
