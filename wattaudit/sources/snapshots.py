"""Stored tables as snapshots.

Rows are dealt to buckets by a hash of the key columns. A change writes the rows of the touched buckets (or, for an append, just the
new rows) into folders of their own and then commits a manifest: a small file that names, for every bucket, the folders that
hold its rows. A manifest is written under a temporary name and renamed, and a name that exists is never overwritten. So a reader
always sees the newest whole snapshot, a killed writer leaves folders that no manifest names, and of two writers that began at the
same snapshot one gets a ``Conflict`` and starts again from the other's result.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.operators.upserts import update_by_key, upsert

BUCKET = "bucket_no"


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    """``folders`` of every bucket, the first free id, and ``marks``: what else holds at this version (last epoch, say)."""

    version: int = 0
    next_id: int = 0
    folders: dict[int, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    """A table of ``schema`` in ``path``, dealt to ``buckets`` by ``keys``. An empty or missing folder is an empty table.

    Rows with equal keys (null is a key like any other) lie in one bucket. The number of buckets is part of the table and
    must be the same for all its writers; the manifest has an entry for each.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64, most_folders: int = 8) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.buckets, self.most_folders = buckets, most_folders

    # --- reading

    def bucket(self) -> Column:
        """Bucket of a row."""
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def snapshot(self) -> Snapshot:
        """The newest whole snapshot."""
        whole = self._manifests()
        return self._manifest(whole[-1]) if whole else Snapshot()

    def _manifests(self) -> list[str]:
        """Names of the whole manifests, the oldest first."""
        fs, path = self._files(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("_"))

    def _manifest(self, name: str) -> Snapshot:
        found = json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0])
        return Snapshot(found["version"], found["next_id"], {int(b): f for b, f in found["folders"].items()}, found["marks"])

    def read(self, buckets: Iterable[int] | None = None, at: Snapshot | None = None) -> DataFrame:
        """Rows of the newest snapshot (or of ``at``), of all buckets or of the given ones; no other folder is listed."""
        at = self.snapshot() if at is None else at
        wanted = at.folders if buckets is None else [b for b in buckets if b in at.folders]
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b in sorted(wanted) for folder in at.folders[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets with keys of ``changes``; as many numbers as there are buckets at most."""
        return sorted(r[0] for r in changes.select(self.bucket().alias(BUCKET)).distinct().collect())

    # --- writing

    def append(self, rows: DataFrame, id_column: str | None = None, marks: dict[str, int] | None = None) -> Snapshot:
        """Add rows. With ``id_column`` they are numbered from the first free id of the snapshot, without gaps.

        Buckets in more than ``most_folders`` pieces are put together on the way.
        """
        old = self.snapshot()
        next_id = old.next_id
        if id_column:
            rows, next_id = self._numbered(rows, id_column, next_id)
        name = self._write(rows)
        folders = {b: [*old.folders.get(b, []), name] for b in self._written(name)}
        many = [b for b, f in folders.items() if len(f) > self.most_folders]
        if many:
            whole = self._write(self.read(many, replace(old, folders=old.folders | folders)))
            folders |= {b: [whole] for b in many}
        return self._commit(old, replace(old, next_id=next_id, folders=old.folders | folders, marks=old.marks | (marks or {})))

    def rewrite(
        self, buckets: list[int], make: Callable[[DataFrame], DataFrame], id_column: str | None = None, marks: dict[str, int] | None = None
    ) -> Snapshot:
        """Replace the rows of ``buckets`` by what ``make`` makes of them; the keys of its rows stay in these buckets.

        With ``id_column`` rows without id get the next free ones.
        """
        old = self.snapshot()
        next_id, folders = old.next_id, {}
        if buckets:
            rows = make(self.read(buckets, old)).select(*self.schema.fieldNames())
            if id_column:
                # Written once, so that what is numbered and what is kept come from the same rows.
                made = self.staged(rows)
                top = made.agg(F.max(id_column)).first()[0]
                next_id = next_id if top is None else max(next_id, top + 1)
                new, next_id = self._numbered(made.where(F.col(id_column).isNull()), id_column, next_id)
                rows = made.where(F.col(id_column).isNotNull()).unionByName(new)
            name = self._write(rows)
            folders = {b: [name] for b in self._written(name)}
        kept = {b: f for b, f in old.folders.items() if b not in buckets}
        return self._commit(old, replace(old, next_id=next_id, folders=kept | folders, marks=old.marks | (marks or {})))

    def load(self, rows: DataFrame, id_column: str | None = None) -> Snapshot:
        """Replace the whole table. With ``id_column`` rows keep their ids, and those without get new ones."""
        return self.rewrite(list(range(self.buckets)), lambda _: rows, id_column)

    def upsert(self, changes: DataFrame, order: str, marks: dict[str, int] | None = None) -> Snapshot:
        """The latest change of each key replaces its row or adds one; only touched buckets are read and written."""
        return self.rewrite(self.touched(changes), lambda base: upsert(base, changes, self.keys, order), marks=marks)

    def update(self, changes: DataFrame) -> Snapshot:
        """Put the non-null fields of ``changes`` into the rows of their keys; unknown keys are ignored."""
        if len(self.keys) > 1:
            raise ValueError("updates need a single key column")
        return self.rewrite(self.touched(changes), lambda base: update_by_key(base, changes, self.keys[0]))

    def vacuum(self, keep: int = 2, seconds: int = 7 * 86_400) -> int:
        """Remove what the newest ``keep`` snapshots do not name, if it is older than ``seconds``; the number of folders and files removed.

        That is replaced rows, what killed writers left, and older manifests. ``seconds`` must be longer than any write or read takes.
        """
        if keep < 1:
            raise ValueError("the newest snapshot is always kept")
        whole = self._manifests()
        named = {f for name in whole[-keep:] for folders in self._manifest(name).folders.values() for f in folders} | set(whole[-keep:])
        gone, until = 0, (time.time() - seconds) * 1000
        for folder in ("data", "manifest"):
            fs, path = self._files(f"{self.path}/{folder}")
            for status in fs.listStatus(path) if fs.exists(path) else ():
                if status.getPath().getName() not in named and status.getModificationTime() <= until:
                    gone += fs.delete(status.getPath(), True)
        return gone

    def staged(self, rows: DataFrame) -> DataFrame:
        """Rows written once beside the table, so that every use of them sees the same ones."""
        folder = f"{self.path}/data/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _numbered(self, rows: DataFrame, id_column: str, first: int) -> tuple[DataFrame, int]:
        """Rows with ids from ``first`` on. One count per written part is read and broadcast."""
        place = F.monotonically_increasing_id()
        staged = self.staged(rows.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND((1 << 33) - 1)}))
        starts, at = [], first
        for part, n in sorted(staged.groupBy("_part").agg(F.count(F.lit(1))).collect()):
            starts.append((part, at))
            at += n
        known = F.broadcast(self.spark.createDataFrame(starts, "_part int, _start long"))
        return staged.join(known, "_part").withColumn(id_column, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start"), at

    def _write(self, rows: DataFrame) -> str:
        """Write rows by bucket into a new folder; a bucket above the target size of a partition is written by several tasks."""
        name = uuid.uuid4().hex
        dealt = rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return name

    def _written(self, name: str) -> list[int]:
        fs, path = self._files(f"{self.path}/data/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]

    def _commit(self, old: Snapshot, new: Snapshot) -> Snapshot:
        new = replace(new, version=old.version + 1)
        name = f"{self.path}/manifest/{new.version:012d}.json"
        fs, target = self._files(name)
        _, temporary = self._files(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        body = {"version": new.version, "next_id": new.next_id, "folders": new.folders, "marks": new.marks}
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(target), no_options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            fs.delete(temporary, False)
            raise Conflict(f"version {new.version} of {self.path} was committed by another writer") from error
        return new

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path


def retried(change: Callable[[], Snapshot], times: int = 5) -> Snapshot:
    """Do a change again from the newest snapshot as long as others commit first."""
    for _ in range(times - 1):
        try:
            return change()
        except Conflict:
            continue
    return change()
