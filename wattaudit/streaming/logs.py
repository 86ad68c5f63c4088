"""Continuous log ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattaudit.schemas import table as schema_of
from wattaudit.sources.logs import log_fields
from wattaudit.sources.snapshots import SnapshotTable
from wattaudit.streaming.tables import EPOCH

#: Mark of a table of windows: microseconds before which windows are final.
WATERMARK = "watermark"
WINDOWS = schema_of("source string, level string, start timestamp, n_lines bigint, n_late bigint")
_KEYS = ["source", "level", "start"]


def read_log_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Lines of log files as they arrive: (file, line)."""
    return spark.readStream.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _parsed(lines: DataFrame, source: str) -> DataFrame:
    fields = log_fields(F.col("line"))
    return lines.where(F.trim("line") != "").select(F.lit(source).alias("source"), *[c.alias(n) for n, c in fields.items()])


def stream_logs(lines: DataFrame, source: str, width: str = "hour") -> DataFrame:
    """Structured log lines counted per (source, level, hour); lines without a time of their own have a null hour, blank
    lines don't count.

    No line is too late: the state is one counter per source, level and hour, which grows with the hours logged and not
    with the lines.
    """
    hour = F.date_trunc(width, "event_time").alias("hour")
    return _parsed(lines, source).groupBy("source", "level", hour).agg(F.count(F.lit(1)).alias("n_lines"))


def window_table(spark: SparkSession, path: str, buckets: int = 16) -> SnapshotTable:
    return SnapshotTable(spark, path, WINDOWS, _KEYS, buckets)


def start_log_windows(
    lines: DataFrame, table: SnapshotTable, checkpoint: str, source: str, seconds: int = 3_600, delay: int = 7_200, **trigger: object
) -> StreamingQuery:
    """Count log lines in windows of ``seconds`` that become final, and late lines beside them.

    The watermark is the latest time seen in earlier batches less ``delay`` seconds. A window that ends at or before it is final: its
    ``n_lines`` never changes again, and a line that comes later still is counted in its ``n_late``. Lines without a time
    have the window null, which is never final. Blank lines don't count. Counts, watermark and epoch are committed in one snapshot, so a batch
    repeated after a failure counts nothing twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        at = table.snapshot()
        if epoch <= at.marks.get(EPOCH, -1):
            return
        before = at.marks.get(WATERMARK)
        known = _parsed(batch, source).select("source", "level", F.when(F.col("event_time").isNotNull(), F.unix_micros("event_time")).alias("at"))
        known = known.withColumn("start", F.timestamp_micros((F.floor(F.col("at") / (seconds * 1_000_000)) * (seconds * 1_000_000)).cast("long")))
        late = F.lit(False) if before is None else F.coalesce(_end(F.col("start"), seconds) <= before, F.lit(False))
        counted = known.groupBy(*_KEYS).agg(
            F.count_if(~late).alias("n_lines"), F.count_if(late).alias("n_late"), F.max("at").alias("latest")
        )
        counted = table.staged(counted)
        latest = counted.agg(F.max("latest")).first()[0]
        marks = {EPOCH: epoch}
        if latest is not None:
            marks[WATERMARK] = max(latest - delay * 1_000_000, before if before is not None else latest - delay * 1_000_000)

        def added(base: DataFrame) -> DataFrame:
            both = base.unionByName(counted.drop("latest"))
            return both.groupBy(*_KEYS).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_late").alias("n_late"))

        table.rewrite(table.touched(counted), added, marks=marks)

    writer = lines.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _end(start: Column, seconds: int) -> Column:
    return F.unix_micros(start) + seconds * 1_000_000


def log_windows(table: SnapshotTable, seconds: int = 3_600) -> DataFrame:
    """Windows of the newest snapshot; ``is_final`` says that ``n_lines`` won't change."""
    at = table.snapshot()
    before = F.lit(at.marks.get(WATERMARK)).cast("long")
    return table.read(at=at).withColumn("is_final", F.coalesce(_end(F.col("start"), seconds) <= before, F.lit(False)))
