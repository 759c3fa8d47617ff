"""Continuous processing of arriving cases with an index checkpoint per (folder, mode).

The file source remembers which files it has seen; which *indices* count is decided here, as in the batch
form: an arrival at or below the checkpoint is dropped, and a failure holds the checkpoint and is tried again with
every batch (at-least-once, so sinks are keyed by mode, scenario, idx).

Each micro-batch writes only below its own batch folders and overwrites them when it is replayed after a
failure. It starts from the state of the batch before, so a replay starts from the same state. Case rows are written
once, with the batch they arrive in. What goes from batch to batch is narrow: the waiting cases (failed, or beyond a
cap) with the batch that holds their rows, and the indices settled above a held checkpoint, as one increment per batch
that is merged now and then. So a batch touches its arrivals and the cases it tries again, however many were
settled while a failure lasts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from caseflow import vocab
from caseflow.operators.incremental import last_indices, select_new, upsert_checkpoints
from caseflow.scale import discard, materialize, spread
from caseflow.sources.files import FILES_PER_TASK, delete_files, list_tree, open_texts, qualified
from caseflow.sources.labels import decoded, file_columns, index_from_name, with_document

CHECKPOINTS = "folder string, mode string, alarm_type string, last_index bigint, updated_at timestamp"
CASES = "scenario string, idx bigint"


def new_names(spark: SparkSession, root: str, seen: str) -> None:
    """Add to the table `seen` the label files of `root` that it does not hold, as parts of 16,384 names.

    A name is listed once, whatever fails: the table is what the stream reads, and what the next listing leaves out.
    """
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(seen)
    begun = folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)
    names = list_tree(spark, root, ".json").filter(F.element_at(F.split("path", "/"), -1).rlike(r"_label_.*\.json$"))
    if begun:
        names = names.join(spark.read.schema("path string").parquet(seen), "path", "left_anti")
    names = materialize(names, "arrived")
    if not (begun and names.isEmpty()):
        spread(names, FILES_PER_TASK).write.mode("append").parquet(seen)


def stream_labels(spark: SparkSession, root: str, seen: str | None = None) -> DataFrame:
    """Label files of `<root>/<scenario>/` as they arrive: scenario, idx, path, body, doc (null for unreadable text).

    A listing is one micro-batch: split by a number of files, lower indices of its later parts would come after
    the checkpoint that its first part moved.

    Spark's file source lists and remembers every file in the driver. With `seen`, a folder that is kept from start to start,
    tasks list `root` when the stream is made, the names are rows of a table there, and the stream reads that table and opens
    the files in tasks. Files that arrive later come with the next start. Where only Spark reaches `root`, Spark lists it.
    """
    known = None if seen is None else qualified(spark, root)
    if known is not None:
        new_names(spark, known, seen)
        texts = open_texts(spark.readStream.schema("path string").parquet(seen), known)
        return _numbered(texts)
    raw = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "*_label_*.json")
        .load(f"{root}/*")
        .select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("body"))
    )
    return _numbered(raw)


def _numbered(texts: DataFrame) -> DataFrame:
    named = texts.select(*file_columns(F.col("path")), "body").withColumn(
        "idx", index_from_name(F.col("file_name"), F.col("scenario"))
    )
    return with_document(named.filter(F.col("idx").isNotNull()))


def unreadable() -> Column:
    """Condition on `stream_labels`: the text is no JSON document."""
    return F.col("doc").isNull()


def _schema(columns: str) -> StructType:
    return StructType.fromDDL(columns)


WAITING = "scenario string, idx bigint, held_by bigint, path string"
# Increments of settled indices between two merges.
MERGE_EVERY = 10


class IncrementalSink:
    """`foreachBatch` body: select new cases, process them, move the checkpoint.

    `process` maps the selected cases to (scenario, idx, ok, ...). Layout below `folder`, each with `batch=<b>`:
    `arrivals` (rows of new cases), `results`, `waiting` (cases still to be tried), `settled` and `merged` (indices done
    above the checkpoint), `state` (checkpoints), and `quarantine`.

    With `unreadable`, a condition on arrivals, such rows go to `quarantine` with the columns named there, a second
    output of the same batch; they neither reach `process` nor hold a checkpoint.
    """

    def __init__(
        self,
        folder: str,
        mode: str,
        process: Callable[[DataFrame], DataFrame],
        columns: str = CASES,
        max_new: int | None = None,
        unreadable: Column | None = None,
        quarantine: str = "scenario string, idx bigint, path string, body string",
    ):
        self.folder, self.mode, self.process, self.columns, self.max_new = folder.rstrip("/"), mode, process, columns, max_new
        self.unreadable, self.quarantine = unreadable, quarantine

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _read(self, spark: SparkSession, kind: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [self._path(kind, b) for b in batches if b >= 0]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, kind: str, batch: int, schema: str) -> DataFrame:
        """Write what a batch adds, and read it back: its plan does not run twice, and a replay starts anew."""
        rows.write.mode("overwrite").parquet(self._path(kind, batch))
        return self._read(rows.sparkSession, kind, schema, [batch])

    def _settled(self, spark: SparkSession, batch: int) -> DataFrame:
        """(scenario, idx) settled up to `batch`: the last merge and the increments since."""
        merge = batch // MERGE_EVERY * MERGE_EVERY
        start = merge if merge > 0 else -1
        merged = self._read(spark, "merged", CASES, [start])
        return merged.unionByName(self._read(spark, "settled", CASES, list(range(start + 1, batch + 1))))

    def __call__(self, arrivals: DataFrame, batch: int) -> None:
        if self.unreadable is None:
            self._advance(arrivals, batch)
            return
        # Files are opened once for both outputs. A row holds only what its own output takes, as Parquet and not in a cache,
        # which spills texts and documents uncompressed.
        good, bad = [f.name for f in _schema(self.columns)], [f.name for f in _schema(self.quarantine)]
        broken = F.coalesce(self.unreadable, F.lit(False))
        marked = arrivals.withColumn("_broken", broken).select(
            "_broken",
            *[c for c in good if c in bad],
            *[F.when(~F.col("_broken"), F.col(c)).alias(c) for c in good if c not in bad],
            *[F.when(F.col("_broken"), F.col(c)).alias(c) for c in bad if c not in good],
        )
        opened = materialize(marked, "opened")
        opened.filter("_broken").select(*bad).write.mode("overwrite").parquet(self._path("quarantine", batch))
        self._advance(opened.filter("NOT _broken").select(*good), batch)
        discard(opened)

    def _advance(self, arrivals: DataFrame, batch: int) -> None:
        spark = arrivals.sparkSession
        names = [f.name for f in _schema(self.columns)]
        state = self._read(spark, "state", CHECKPOINTS, [batch - 1])
        waiting = self._read(spark, "waiting", WAITING, [batch - 1])
        settled = self._settled(spark, batch - 1)
        marks = last_indices(state, self.mode)
        floor = F.coalesce("last_index", F.lit(vocab.INITIAL_LAST_INDEX))

        # New cases: above the checkpoint, not settled, and not waiting unless an earlier path replaces the stored row.
        path = F.col("path") if "path" in names else F.lit(None).cast("string")
        rows = arrivals.select(*names, path.alias("_path")).join(marks, "scenario", "left").filter(F.col("idx") > floor).drop("last_index")
        first = rows.groupBy("scenario", "idx").agg(F.min_by(F.struct(*names, "_path"), F.struct("_path")).alias("case")).select("case.*")
        first = first.join(settled, ["scenario", "idx"], "left_anti")
        held = waiting.select("scenario", "idx", F.col("path").alias("_held"), F.lit(True).alias("_waits"))
        fresh = first.join(held, ["scenario", "idx"], "left").filter(F.col("_waits").isNull() | (F.col("_path") < F.col("_held")))
        fresh = self._write(fresh.select(*names, "_path"), "arrivals", batch, f"{self.columns}, _path string")

        mine = fresh.select("scenario", "idx", F.lit(batch).cast("bigint").alias("held_by"), F.col("_path").alias("path"))
        everything = waiting.join(mine, ["scenario", "idx"], "left_anti").unionByName(mine)
        chosen = materialize(select_new(everything, state, self.mode, max_new=self.max_new), "chosen")
        holders = [r[0] for r in chosen.select("held_by").distinct().collect()]  # at most one number per batch
        parts = [self._read(spark, "arrivals", self.columns, [b]).withColumn("held_by", F.lit(b).cast("bigint")) for b in holders]
        stored = reduce(DataFrame.unionByName, parts) if parts else fresh.select(*names).withColumn("held_by", F.lit(batch).cast("bigint"))
        selected = stored.join(chosen.select("scenario", "idx", "held_by", "previous_last_index"), ["scenario", "idx", "held_by"]).drop("held_by")
        self.process(selected).write.mode("overwrite").parquet(self._path("results", batch))
        outcomes = spark.read.parquet(self._path("results", batch)).select("scenario", "idx", "ok")

        done = outcomes.groupBy("scenario", "idx").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")).filter("ok").select("scenario", "idx")
        done = self._write(done, "settled", batch, CASES)
        waiting = self._write(everything.join(done, ["scenario", "idx"], "left_anti"), "waiting", batch, WAITING)

        # The checkpoint is the last settled index below the first waiting one.
        every = settled.unionByName(done)
        limit = waiting.groupBy("scenario").agg(F.min("idx").alias("_first"))
        below = every.join(limit, "scenario", "left").filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first")))
        moved = below.groupBy("scenario").agg(F.max("idx").alias("last_index"))
        changed = moved.join(marks.withColumnRenamed("last_index", "_before"), "scenario", "left").filter(
            F.col("last_index") > F.coalesce("_before", F.lit(vocab.INITIAL_LAST_INDEX))
        )
        rows = changed.select(
            F.col("scenario").alias("folder"),
            F.lit(self.mode).alias("mode"),
            F.col("scenario").alias("alarm_type"),
            "last_index",
            F.current_timestamp().alias("updated_at"),
        )
        state = self._write(upsert_checkpoints(state, rows), "state", batch, CHECKPOINTS)
        if batch > 0 and batch % MERGE_EVERY == 0:
            now = last_indices(state, self.mode)
            above = every.join(now, "scenario", "left").filter(F.col("idx") > floor).select("scenario", "idx")
            above.write.mode("overwrite").parquet(self._path("merged", batch))

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """Unreadable arrivals of all batches, with their batch."""
        return spark.read.schema(f"{self.quarantine}, batch int").parquet(f"{self.folder}/quarantine")

    def results(self, spark: SparkSession) -> DataFrame:
        """Latest outcome per case over all batches."""
        written = spark.read.parquet(f"{self.folder}/results")
        values = [c for c in written.columns if c not in ("scenario", "idx", "batch")]
        latest = written.groupBy("scenario", "idx").agg(F.max_by(F.struct(*values, "batch"), "batch").alias("r"))
        return latest.select("scenario", "idx", "r.*")

    def checkpoints(self, spark: SparkSession) -> DataFrame:
        """Checkpoint table after the last batch: the newest entry per (folder, mode)."""
        versions = spark.read.parquet(f"{self.folder}/state")
        values = ["alarm_type", "last_index", "updated_at"]
        return (
            versions.groupBy("folder", "mode").agg(F.max_by(F.struct(*values), "batch").alias("r")).select("folder", "mode", "r.*")
        )


def delete_stored(spark: SparkSession, root: str, sink: IncrementalSink) -> None:
    """Delete the label files of `root` whose rows the sink has stored; call it when the stream has ended.

    Waiting cases are tried again from their stored rows, so these files are not opened again. Unreadable files, and those
    that were not taken as cases, stay.
    """
    known = qualified(spark, root)
    if known is None:
        raise ValueError(f"{root}: tasks cannot delete files there")
    stored = spark.read.schema("_path string").parquet(f"{sink.folder}/arrivals").select(F.col("_path").alias("path"))
    delete_files(spread(materialize(list_tree(spark, known, ".json").join(stored, "path", "left_semi"), "stored"), FILES_PER_TASK), known)


def start(arrivals: DataFrame, sink: IncrementalSink) -> StreamingQuery:
    """Process everything available and stop; run it again (or on a schedule) for later arrivals."""
    return (
        arrivals.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{sink.folder}/source")
        .trigger(availableNow=True)
        .start()
    )
