"""File resolution, sinks, streaming and the model flows, on data derived from the tables.

The flows call small deterministic stand-ins for a model, so that their SQL twins can say what must come out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators import rounds
from caseflow.plans import documents
from caseflow.plans.common import Registry, table
from caseflow.plans.ranking import SQL_PREDICTIONS, predictions
from caseflow.operators.evaluate import rank_predictions
from caseflow.scale import discard, materialize, new_folder
from caseflow.sources import labels, tables
from caseflow.sources.files import write_named_files
from caseflow.streaming.ingest import CASES, IncrementalSink, delete_stored, start, stream_labels, unreadable

registry = Registry()


# --- file names -------------------------------------------------------------------------------
FILE_NAME = """CASE e % 8
  WHEN 0 THEN concat(s, '_', i, '_label_', e, '.json') WHEN 1 THEN concat(i, '_label_', e, '.json')
  WHEN 2 THEN concat('label_', i, '.json') WHEN 3 THEN concat(i, '.json') WHEN 4 THEN concat(s, '_', i, '_case_', e, '.json')
  WHEN 5 THEN concat('case-', i, '.json') WHEN 6 THEN concat('odd_', i, '_label_', e, '.json') ELSE concat('notes_', e, '.txt') END"""

SQL_FILES = f"""files AS (
  SELECT s AS scenario, e, i AS idx, {FILE_NAME} AS file_name, '/root/' || s || '/' || {FILE_NAME} AS path
  FROM (SELECT event_type AS s, event_id AS e, event_id // 20 AS i FROM events))"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File list with all naming patterns; about twenty files share an index."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("s"), F.col("event_id").alias("e"), F.expr("event_id div 20").alias("i"))
    path = F.concat(F.lit("/root/"), F.col("s"), F.lit("/"), F.expr(FILE_NAME))
    return events.select(*labels.file_columns(path))


@registry.add(f"""WITH {SQL_FILES}
SELECT scenario, idx, min(path) AS label_path FROM files WHERE e % 8 IN (0, 6) GROUP BY 1, 2""")
def discovered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.discover(event_files(spark, sf_dir))


@registry.add(f"""WITH {SQL_FILES},
cand AS (
  SELECT scenario, idx, path, e % 8 AS pri, 'label' AS kind FROM files WHERE e % 8 < 4
  UNION ALL SELECT scenario, idx, path, CASE e % 8 WHEN 4 THEN 0 WHEN 5 THEN 3 ELSE 4 END, 'case' FROM files WHERE e % 8 IN (3, 4, 5)),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY scenario, idx, kind ORDER BY pri, path) = 1),
wide AS (SELECT scenario, idx, max(path) FILTER (kind = 'label') AS label_path, max(path) FILTER (kind = 'case') AS case_path FROM best GROUP BY 1, 2)
SELECT scenario, idx, label_path, coalesce(case_path, label_path) AS case_path,
       CASE WHEN label_path IS NULL THEN 'unresolved' ELSE 'resolved' END AS outcome FROM wide""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.resolve_paths(event_files(spark, sf_dir))


# --- sinks ------------------------------------------------------------------------------------
@registry.add(f"""WITH {SQL_PREDICTIONS}
SELECT method AS mode, scenario, count(*) AS n, sum(case_idx)::BIGINT AS total, count(*) FILTER (groundtruth <> '' AND rank = 1) AS correct,
       count(*) FILTER (pred = '') AS blank FROM preds GROUP BY 1, 2""")
def prediction_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write predictions in all formats, read the lines and the CSV back, and join the two."""
    ranked = rank_predictions(predictions(spark, sf_dir)).withColumn("mode", F.col("method")).drop("status")
    meta = spark.createDataFrame([("brand rankings",)], "run string")
    out = new_folder(spark, "predictions")
    tables.write_predictions(ranked, meta, out, "all")
    lines = tables.read_jsonl(
        spark, f"{out}/jsonl", "case_idx bigint, groundtruth string, pred_rc array<string>, is_correct boolean, mode string, scenario string"
    )
    csv = spark.read.option("header", "true").option("escape", '"').csv(f"{out}/csv").select(
        "mode", "scenario", F.col("case_idx").cast("bigint").alias("case_idx"), F.from_json("pred_rc", "array<string>").alias("csv_rc")
    )
    both = lines.join(csv, ["mode", "scenario", "case_idx"]).filter(F.col("pred_rc") == F.col("csv_rc"))
    return both.groupBy("mode", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.sum("case_idx").alias("total"), F.count_if("is_correct").alias("correct"),
        F.count_if(F.size("pred_rc") == 0).alias("blank"),
    )


# --- streaming --------------------------------------------------------------------------------
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _arrivals(spark: SparkSession, folder: str, names: str) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", names).parquet(folder)
    return raw.select(F.col("event_type").alias("scenario"), F.col("event_id").alias("idx"), "value")


def _sink(spark: SparkSession) -> IncrementalSink:
    return IncrementalSink(
        new_folder(spark, "stream"),
        "tree_infer",
        lambda selected: selected.select("scenario", "idx", (F.col("value") > 0.05).alias("ok")),
        columns=f"{CASES}, value double",
    )


def _stream(spark: SparkSession, sf_dir: str) -> IncrementalSink:
    sink = _sink(spark)
    start(_arrivals(spark, sf_dir, "events*.parquet"), sink).awaitTermination()
    return sink


@registry.add("""WITH fails AS (SELECT event_type AS scenario, min(event_id) AS first_failed FROM events WHERE value <= 0.05 GROUP BY 1)
SELECT event_type AS folder, 'tree_infer' AS mode, max(event_id) FILTER (first_failed IS NULL OR event_id < first_failed) AS last_index
FROM events LEFT JOIN fails ON scenario = event_type GROUP BY 1""")
def streamed_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints after a stream over the event files; a failure holds the checkpoint below it."""
    return _stream(spark, sf_dir).checkpoints(spark).select("folder", "mode", "last_index")


@registry.add("""WITH fails AS (SELECT event_type AS scenario, min(event_id) AS first_failed FROM events WHERE value <= 0.05 GROUP BY 1)
SELECT event_type AS folder, max(event_id) FILTER (first_failed IS NULL OR event_id < first_failed) AS last_index, count(*) AS cases,
       count(*) FILTER (value > 0.05) AS succeeded
FROM events LEFT JOIN fails ON scenario = event_type GROUP BY 1""")
def streamed_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of several files each, unordered inside: the same checkpoints and results as in one batch."""
    events = table(spark, sf_dir, "events")
    end = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    folder, sink = new_folder(spark, "arrivals"), _sink(spark)
    for part in range(3):
        events.filter(F.expr(f"event_id * 3 div {end} = {part}")).repartition(4, "event_id").write.mode("append").parquet(folder)
        start(_arrivals(spark, folder, "*.parquet"), sink).awaitTermination()
    counted = sink.results(spark).groupBy("scenario").agg(F.count(F.lit(1)).alias("cases"), F.count_if("ok").alias("succeeded"))
    marks = sink.checkpoints(spark).select("folder", "last_index")
    return marks.join(counted.withColumnRenamed("scenario", "folder"), "folder")


BATCHES = 5


@registry.add(f"""WITH parts AS (
  SELECT event_type AS scenario, event_id AS idx, value, event_id * {BATCHES} // (SELECT max(event_id) + 1 FROM events) AS part,
         event_id = min(event_id) OVER (PARTITION BY event_type) AS lasting FROM events)
SELECT scenario AS folder, count(*) AS cases, sum(CASE WHEN lasting THEN {BATCHES} - part ELSE 1 END)::BIGINT AS tries,
       count(*) FILTER (lasting) AS waiting, (SELECT max(idx) FROM parts p WHERE p.scenario = parts.scenario AND p.idx > min(parts.idx)) AS last_settled
FROM parts GROUP BY 1""")
def streamed_with_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first case of every scenario fails in all of five batches: it alone is tried again, and no checkpoint moves."""
    events = table(spark, sf_dir, "events")
    end = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    lasting = materialize(events.groupBy(F.col("event_type").alias("scenario")).agg(F.min("event_id").alias("idx")).withColumn("_lasting", F.lit(True)), "lasting")
    sink = IncrementalSink(
        new_folder(spark, "stream"),
        "tree_infer",
        lambda selected: selected.join(lasting, ["scenario", "idx"], "left").select("scenario", "idx", F.col("_lasting").isNull().alias("ok")),
        columns=f"{CASES}, value double",
    )
    folder = new_folder(spark, "arrivals")
    for part in range(BATCHES):
        events.filter(F.expr(f"event_id * {BATCHES} div {end} = {part}")).write.mode("append").parquet(folder)
        start(_arrivals(spark, folder, "*.parquet"), sink).awaitTermination()
    if not sink.checkpoints(spark).isEmpty():
        raise AssertionError("a checkpoint moved beyond a lasting failure")
    tries = spark.read.parquet(f"{sink.folder}/results").groupBy(F.col("scenario").alias("folder")).agg(
        F.countDistinct("idx").alias("cases"), F.count(F.lit(1)).alias("tries"), F.max(F.when(F.col("ok"), F.col("idx"))).alias("last_settled")
    )
    waits = spark.read.parquet(f"{sink.folder}/waiting/batch={BATCHES - 1}").groupBy(F.col("scenario").alias("folder")).agg(F.count(F.lit(1)).alias("waiting"))
    return tries.join(waits, "folder")


@registry.add(f"""WITH {documents.SQL_EVENTS}
SELECT scenario, count(*) FILTER (e % 11 <> 3) AS processed, count(*) FILTER (e % 11 = 3) AS quarantined, count(DISTINCT e * 2 // (SELECT max(e) + 1 FROM ev)) FILTER (e % 11 = 3) AS batches,
       max(e) FILTER (e % 11 <> 3) AS last_index FROM ev GROUP BY 1""")
def streamed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event documents as label files in two batches; every eleventh is cut and goes to quarantine.

    Files whose rows are stored are deleted before the next ones arrive; the cut ones stay.
    """
    docs = documents.case_documents(spark, sf_dir).select(
        "scenario", "idx", F.when(F.col("idx") % 11 == 3, F.left("body", F.length("body") - 1)).otherwise(F.col("body")).alias("body")
    )
    end = (docs.agg(F.max("idx")).first()[0] or 0) + 1
    root = new_folder(spark, "labels")
    sink = IncrementalSink(
        new_folder(spark, "stream"),
        "tree_infer",
        lambda selected: selected.select("scenario", "idx", labels.is_object(F.col("doc")).alias("ok")),
        columns=f"{CASES}, path string, doc variant",
        unreadable=unreadable(),
    )
    name = F.format_string("%s/%s_%d_label_x.json", "scenario", "scenario", "idx")
    for part in range(2):
        rows = docs.filter(F.expr(f"idx * 2 div {end} = {part}")).select(name.alias("path"), "body")
        if part > 0:
            delete_stored(spark, root, sink)
        discard(materialize(write_named_files(rows, root), "written"))
        start(stream_labels(spark, root, f"{sink.folder}/names"), sink).awaitTermination()
    bad = sink.quarantined(spark).groupBy("scenario").agg(F.count(F.lit(1)).alias("quarantined"), F.countDistinct("batch").alias("batches"))
    good = sink.results(spark).filter("ok").groupBy("scenario").agg(F.count(F.lit(1)).alias("processed"))
    marks = sink.checkpoints(spark).select(F.col("folder").alias("scenario"), "last_index")
    return good.join(bad, "scenario", "left").join(marks, "scenario").select("scenario", "processed", F.coalesce("quarantined", F.lit(0)).alias("quarantined"), F.coalesce("batches", F.lit(0)).alias("batches"), "last_index")


# --- model flows ------------------------------------------------------------------------------
def model_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the event documents, stored once: every stage of a flow reads them again."""
    flat = documents.cases(spark, sf_dir).withColumnRenamed("idx", "case_idx")
    return materialize(flat.select("scenario", "case_idx", "sop", "candidates", "alarm_time_ms", "sem"), "cases")


def stand_in(marker: str = vocab.STOP_MARKER):
    """A model that answers with the case number.

    It refuses cases divisible by 10 as verifier or reasoner, and as Meta it stops in round case % 4; the
    round is the leading number of the previous Meta text. Built as a closure, so it travels to the workers
    by value and they need not have this package.
    """
    form = re.compile(r"(\w+) (\d+) (?:\[Last Meta\]\n)?(\d+)?")

    def answer(prompts, sampler):
        answers = []
        for prompt in prompts:
            role, case, seen = form.match(prompt).groups()
            case, seen = int(case), int(seen or 0)
            if case % 10 == 0 and role in ("verifier", "reasoner"):
                answers.append(None)
            elif role == "meta" and seen >= case % 4:
                answers.append(f"{seen + 1} {marker}")
            else:
                answers.append(f"{seen + 1} {sampler['sample']} of {case}")
        return answers

    return answer


@registry.add(f"""WITH {documents.SQL_EVENTS},
coop AS (SELECT scenario, e FROM ev WHERE {documents.SQL_SOP} = ''),
state AS (
  SELECT scenario, e AS case_idx, CASE WHEN e % 10 = 0 AND e % 4 > 0 THEN 0 ELSE least(e % 4, 3) END AS rounds,
         CASE WHEN e % 10 = 0 AND e % 4 > 0 THEN NULL WHEN e % 4 < 3 THEN e % 4 END AS stop_round,
         e % 10 = 0 AND e % 4 > 0 AS failed FROM coop)
SELECT scenario, case_idx, rounds::BIGINT AS rounds, stop_round::INT AS stop_round, stop_round IS NOT NULL AS stopped, failed,
       CASE WHEN failed THEN 'skipped' ELSE 'processed' END AS status FROM state""")
def cooperation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds at most: a case stops in round case % 4, or runs out of rounds."""
    cases = rounds.route(model_cases(spark, sf_dir)).filter(F.col("mode") == "cooperation").drop("mode")
    meta = "meta {case_idx} {last_round_outputs}"
    _responses, state = rounds.cooperation(cases, stand_in(), meta, "reasoner {case_idx} 0 {meta_output}", max_rounds=3)
    return state


@registry.add(f"""WITH {documents.SQL_EVENTS}
SELECT scenario, e AS case_idx, CASE WHEN {documents.SQL_SOP} = '' THEN 'routed' WHEN e % 10 = 0 THEN 'sampled' ELSE 'verified' END AS stage,
       CASE WHEN {documents.SQL_SOP} <> '' AND e % 10 <> 0 THEN 'processed' ELSE 'skipped' END AS status FROM ev""")
def competition_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases without a procedure stay routed; refused verifications stay sampled."""
    _responses, accounting = rounds.competition(
        model_cases(spark, sf_dir), stand_in(), "competition {case_idx} 0 {sop}", "verifier {case_idx} 0 {reasoner_outputs}"
    )
    return accounting


@registry.add(f"""WITH {documents.SQL_EVENTS}
SELECT scenario, e AS case_idx, sampler AS sample, '1 ' || sampler || ' of ' || e AS text
FROM ev, (VALUES ('Reasoner1'), ('Reasoner2'), ('Reasoner3')) AS s(sampler)""")
def sampled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt with every sampler."""
    events = table(spark, sf_dir, "events")
    prompts = events.select(
        F.col("event_type").alias("scenario"), F.col("event_id").alias("case_idx"), F.concat(F.lit("competition "), "event_id", F.lit(" 0")).alias("prompt")
    )
    return rounds.invoke(prompts, stand_in(), samplers=vocab.SAMPLERS).select("scenario", "case_idx", "sample", "text")
