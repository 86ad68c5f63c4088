"""Log lines: numbering of real files and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Structure of a log line, default level, and lines taken per file by the capped import.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*\|\s*([A-Z]+)\s*\|\s*([^|]+)\|\s*(.*)$"
DEFAULT_LEVEL = "INFO"
MAX_LINES = 5_000


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as (file, line_no, line).

    Spark reads a file in blocks and a block in order. The number of a line is its place in its block plus the lines of
    the blocks before, so no task sees more than one block of a file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
        F.monotonically_increasing_id().alias("_order"),
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("_order"))
    return lines.join(blocks, ["file", "block"]).select("file", (place + F.col("_before")).alias("line_no"), "line")


def log_fields(line: Column) -> dict[str, Column]:
    """Fields of a line; one that does not follow the pattern is level INFO without logger and description."""
    fits = line.rlike(LINE)

    def part(group: int) -> Column:
        return F.when(fits, F.trim(F.regexp_extract(line, LINE, group)))

    return {
        "event_time": F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")),
        "level": F.coalesce(part(2), F.lit(DEFAULT_LEVEL)),
        "logger_name": part(3),
        "description": part(4),
        "message": line,
    }


def parse_logs(lines: DataFrame, source: str, max_lines: int | None = None) -> DataFrame:
    """Log rows of lines (file, line_no, line); blank lines are dropped but keep their number.

    ``max_lines`` takes only the first lines of each file, blank ones included.
    """
    if max_lines is not None:
        lines = lines.where(F.col("line_no") <= max_lines)
    kept = lines.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    context = F.create_map(
        F.lit("imported"), F.lit("true"), F.lit("line_number"), F.col("line_no").cast("string")
    )
    fields = log_fields(F.col("line"))
    return kept.select(
        F.lit(source).alias("source"), *[c.alias(n) for n, c in fields.items()], F.col("file").alias("log_file"),
        "line_no", context.alias("context"),
    )
