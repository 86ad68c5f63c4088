"""What several corpus operators share: written tables, deterministic splits, words as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattaudit.session import work_dir

#: Words everywhere: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor recomputes nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def words(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. ``bytes.split`` and ``bytes.lower`` know ASCII only, as wanted."""
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows that hold about ``size`` bytes at most, or one row."""
    step = max(1, min(rows, size * batch.num_rows // max(size, batch.nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by column ``key``.

    The last group of a batch waits for the next one, so no more than one batch and one group are held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = (keys != keys[-1]).nonzero()[0]
        cut = int(starts[-1]) + 1 if len(starts) else 0
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)], schema=batch.schema)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
