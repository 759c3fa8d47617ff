"""Stored tables that several writers share: versioned checkpoints, and outputs that a rerun replaces.

A checkpoint store is a folder of immutable versions. A writer reads version n, writes the rows of version n + 1 to a
folder of its own, and publishes it by creating the marker of n + 1, which succeeds for one writer only. Whoever comes
second gets a `ConflictError` and has published nothing. Readers follow markers, so they never see half a version.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.incremental import upsert_checkpoints
from caseflow.scale import discard, materialize

# So many partitions every task may write a file of, without dealing the rows out by partition.
FEW_PARTITIONS = 64
CHECKPOINTS = "folder string, mode string, alarm_type string, last_index bigint, updated_at timestamp"


class ConflictError(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


def publish_file(spark: SparkSession, path: str, text: str) -> bool:
    """Create `path` with `text` if it does not exist, in one step; False if it does.

    The text is written under a name of its own first. A hard link (local files) or a rename that does not overwrite
    (other schemes) then makes it visible whole, for one of several writers.
    """
    target = urlparse(path)
    if target.scheme in ("", "file"):
        local = unquote(target.path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    hadoop = spark._jvm.org.apache.hadoop.fs
    final = hadoop.Path(path)
    draft = hadoop.Path(final.getParent(), f".{uuid.uuid4().hex}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        hadoop.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(
            draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        )
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        files.delete(draft, False)
        return False
    return True


class CheckpointStore:
    """Versions of the checkpoint table (one row per folder and mode) under `folder`.

    `data/<name>/` holds the rows of a version as Parquet, `published/<n>` names the folder of version n. Version 0
    is the empty table and always there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _published(self) -> dict[int, str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        markers = hadoop.Path(f"{self.folder}/published")
        files = markers.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(markers):
            return {}
        names = [status.getPath().getName() for status in files.listStatus(markers)]
        return {int(name): f"{self.folder}/published/{name}" for name in names if name.isdigit()}

    def versions(self) -> list[int]:
        return [0, *sorted(self._published())]

    def latest(self) -> int:
        return self.versions()[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, of the latest one by default; an unknown version is an error."""
        markers = self._published()
        number = max(markers, default=0) if version is None else version
        if number == 0:
            return self.spark.createDataFrame([], CHECKPOINTS)
        if number not in markers:
            raise ValueError(f"version {number} is not published")
        name = self.spark.read.text(markers[number], wholetext=True).first()[0]
        return self.spark.read.schema(CHECKPOINTS).parquet(f"{self.folder}/data/{name}")

    def commit(self, changed: DataFrame, based_on: int) -> int:
        """Publish version `based_on` + 1: the rows of `based_on` with those of `changed` on top; returns its number.

        Raises ConflictError, and changes nothing, when that version is published already.
        """
        number = based_on + 1
        if number in self._published():
            raise ConflictError(f"version {number} is published")
        name = f"v{number}-{uuid.uuid4().hex}"
        rows = upsert_checkpoints(self.read(based_on), changed.select(*[f.split()[0] for f in CHECKPOINTS.split(", ")]))
        rows.write.parquet(f"{self.folder}/data/{name}")
        if not publish_file(self.spark, f"{self.folder}/published/{number}", name):
            raise ConflictError(f"version {number} was published meanwhile")
        return number

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """Commit `change(latest rows)`; after a conflict it is computed again from the then latest rows."""
        for _ in range(attempts):
            based_on = self.latest()
            try:
                return self.commit(change(self.read(based_on)), based_on)
            except ConflictError:
                continue
        raise ConflictError(f"gave up after {attempts} attempts")


def replace_rows(rows: DataFrame, out: str, partitions: Sequence[str], keys: Sequence[str]) -> None:
    """Write `rows` to the Parquet table `out`, replacing stored rows of the same `keys`; other rows stay.

    Only partitions that `rows` touches are read and written again, so repeating a write changes nothing. `keys`
    include the partition columns, in which an empty text becomes null. Of rows that share their keys one stays, and
    null keys are equal to each other. What is repeated and what is replaced is found by the keys alone: whole rows move only
    where some keys are repeated, or some stored rows of a partition stay and others do not.
    """
    spark = rows.sparkSession
    keys = list(keys)
    if not set(partitions) <= set(keys):
        raise ValueError("partition columns must be part of the keys")
    written = materialize(rows, "new_rows")
    repeated = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)
    new = written
    if not repeated.isEmpty():
        once = _matching(written, repeated, keys, "left_semi").dropDuplicates(keys)
        new = _matching(written, repeated, keys, "left_anti").unionByName(once)
    touched = written.select(*partitions).distinct()
    merged = new
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        stored = _matching(spark.read.schema(written.schema).parquet(out), touched, partitions, "left_semi")
        kept = _matching(stored, written.select(*keys), keys, "left_anti")
        before, stay = stored.count(), kept.select(*keys).count()
        if stay > 0:
            merged = (stored if stay == before else kept).select(*written.columns).unionByName(new)
    # A dynamic overwrite puts the rows beside the table and replaces partitions when all are written, so the table itself may
    # be read meanwhile. With few partitions every task writes its rows of each; with more they are dealt out first, in which
    # a partition with a large part of all rows is split into several files.
    dealt = merged if touched.limit(FEW_PARTITIONS + 1).count() <= FEW_PARTITIONS else merged.hint("rebalance", *partitions)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(out)
    discard(written)


def _matching(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join where two nulls are equal."""
    renamed = other.select(*[F.col(k).alias(f"_k_{k}") for k in on])
    return rows.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]), how)
