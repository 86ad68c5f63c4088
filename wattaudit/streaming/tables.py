"""Results of a stream as stored tables of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattaudit.sources.snapshots import SnapshotTable

#: Mark of a table: the last epoch of the stream that it holds.
EPOCH = "epoch"


def start_update_table(stream: DataFrame, table: SnapshotTable, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Replace the rows of ``table`` whose keys a batch changes, in one snapshot per batch that has rows.

    The epoch is committed with the rows, so a batch that is repeated after a failure changes nothing. Readers take the newest
    snapshot; nothing older is read.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch > table.snapshot().marks.get(EPOCH, -1):
            table.upsert(table.staged(batch.withColumn("_epoch", F.lit(epoch))), "_epoch", {EPOCH: epoch})
        else:  # the state of the stream still has to advance
            batch.write.format("noop").mode("overwrite").save()

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
