"""Report lines as ordered text files with an index of accounts.

Lines are sorted over all tasks by account, bill and line, and a file is closed when it is full. The index says for every account
in which files its lines are, from which byte on and how many, so a report is read back from its own files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattaudit.session import work_dir

#: Bytes after which a new file begins.
FILE_BYTES = 8 << 20
_ORDER = ["bill_account", "bill_no", "line_no"]
_INDEX = "bill_account string, file string, first_byte long, n_bytes long"


def write_reports(lines: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write report lines (bill_account, bill_no, line_no, line) under ``folder``: ``files`` and ``index``.

    The report of one account may fill several tasks and files. A line break within a line becomes a blank, so that a line stays one; lines of
    bills without account make a report of the account null. The index is written last: without it there is no report.
    """
    spark = lines.sparkSession
    text = F.coalesce(F.translate("line", "\r\n", "  "), F.lit("")).alias("line")
    size = (F.octet_length("line") + 1).alias("size")
    # The size is a column of its own, so that the index is made without moving the lines.
    ranged = lines.select(*_ORDER, text).select("*", size).repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id())
    staged = work_dir(spark, "report-lines")
    ranged.write.parquet(staged)
    ranged = spark.read.schema(ranged.schema).parquet(staged)
    # Each part was one task's share of the rows, whatever the accounts.
    before = W.partitionBy("part").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    name = F.format_string("%06d-%06d", F.col("part"), F.expr(f"at div {file_bytes}").cast("int"))
    placed = placed.withColumn("file", name).sortWithinPartitions("file", *_ORDER)
    placed.select("line", "file").write.partitionBy("file").text(f"{folder}/files")
    start = F.min("at").over(W.partitionBy("file"))
    counted = placed.groupBy("file", "bill_account").agg(F.min("at").alias("at"), F.sum("size").alias("n_bytes"))
    index = counted.select("bill_account", "file", (F.col("at") - start).alias("first_byte"), F.col("n_bytes").cast("long"))
    index.repartitionByRange("bill_account", "file").sortWithinPartitions("bill_account", "file").write.parquet(f"{folder}/index")


def read_report(spark: SparkSession, folder: str, account: str | None) -> DataFrame:
    """Lines of an account's report in order: (file, place, line). Only the files that the index names are opened."""
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index").where(F.col("bill_account").eqNullSafe(F.lit(account)))
    names = [r[0] for r in index.select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "file string, place int, line string")
    whole = spark.read.text([f"{folder}/files/file={n}" for n in sorted(names)], wholetext=True)
    named = whole.select(F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+)/", 1).alias("file"), F.col("value").cast("binary").alias("bytes"))
    part = F.substring("bytes", (F.col("first_byte") + 1).cast("int"), (F.col("n_bytes") - 1).cast("int")).cast("string")
    found = named.join(F.broadcast(index), "file").select("file", F.posexplode(F.split(part, "\n", -1)).alias("place", "line"))
    return found.orderBy("file", "place")
