"""Table readers and writers: JSON, JSON lines, predictions, metrics, prompts, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.scale import materialize
from caseflow.sources.files import write_named_files
from caseflow.sources.labels import decoded
from caseflow.sources.store import replace_rows

PREDICTION_CSV = (
    "case_idx",
    "alarm_type",
    "alarm_time",
    "case_file_path",
    "label_file_path",
    "groundtruth",
    "pred_top1_rc",
    "pred_rc",
    "cot",
    "rank",
    "is_correct",
)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def csv_columns(predictions: DataFrame) -> list[Column]:
    """The fixed CSV columns; nested values as JSON text, absent columns as null."""
    kinds = dict(predictions.dtypes)

    def column(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        nested = kinds[name].startswith(("array", "map", "struct"))
        return (F.to_json(name) if nested else F.col(name)).alias(name)

    return [column(name) for name in PREDICTION_CSV]


def write_predictions(predictions: DataFrame, meta: DataFrame, out: str, fmt: str = "parquet", compression: str = "gzip") -> list[str]:
    """Write predictions under `out`, partitioned by mode, scenario and run_name where present.

    `fmt` is parquet, json, jsonl, csv or all (json and jsonl are one object per line). Every task writes its own
    rows; nothing passes the driver. For all formats the rows are computed once: the others are written from the Parquet files.
    Lines and CSV repeat names and texts in every row, so their part files are compressed; `compression` "none" leaves them plain.
    """
    formats = ("parquet", "jsonl", "csv") if fmt == "all" else (fmt,)
    parts = [c for c in ("mode", "scenario", "run_name") if c in predictions.columns]
    written = []
    for name in formats:
        target = f"{out}/{name}"
        if name == "csv":
            rows = predictions.select(*parts, *csv_columns(predictions))
            rows.write.partitionBy(*parts).option("compression", compression).option("header", "true").option("escape", '"').csv(target)
        elif name in ("json", "jsonl"):
            predictions.write.partitionBy(*parts).option("compression", compression).json(target)
        elif name == "parquet":
            predictions.write.partitionBy(*parts).parquet(target)
            # With its schema, so that folder names that look like numbers stay text.
            predictions = predictions.sparkSession.read.schema(predictions.schema).parquet(target)
        else:
            raise ValueError(f"unknown format {name!r}")
        written.append(target)
    meta.write.json(f"{out}/meta")
    return written


PROMPT_KEY = ("role", "scenario", "case_idx", "round", "sample")


def write_metrics(metrics: DataFrame, out: str) -> None:
    """Metric rows as JSON lines and CSV; both are replaced as a whole, so that a rerun leaves one result."""
    metrics = materialize(metrics, "metrics")
    metrics.write.mode("overwrite").json(f"{out}/metrics_json")
    metrics.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{out}/metrics_csv")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with all columns of PROMPT_KEY: without rounds or samples these are 0 and an empty text."""
    rows = rows if "round" in rows.columns else rows.withColumn("round", F.lit(0))
    return rows if "sample" in rows.columns else rows.withColumn("sample", F.lit(""))


def write_prompts(prompts: DataFrame, out: str) -> None:
    """The prompts exactly as sent, one row per (role, scenario, case_idx, round, sample).

    A prompt that is written again replaces the stored one.
    """
    replace_rows(_keyed(prompts), out, ["role", "scenario", "round"], PROMPT_KEY)


def write_responses(responses: DataFrame, out: str) -> None:
    """Answers, stored under the same key as their prompts; an answer that is written again replaces the stored one."""
    replace_rows(_keyed(responses), out, ["role", "scenario", "round"], PROMPT_KEY)


def response_text(text: Column, label: Column) -> Column:
    """Presentation form of a stored answer: header line, text, closing rule."""
    return F.concat(F.lit("=== Response "), label, F.lit(" ===\n"), text, F.lit(f"\n\n{vocab.RULE}\n\n"))


def write_response_tree(responses: DataFrame, root: str) -> DataFrame:
    """Answer files of a cooperation run: `<root>/<case_idx>/round<n>/<role>/raw_responses.txt`, one per row.

    Takes case_idx, round, role and text; returns (path, bytes) once it is written or counted. Written again, the
    files are replaced by equal ones. `read_response_tree` reads them back.
    """
    path = F.format_string("%d/round%d/%s/raw_responses.txt", F.col("case_idx"), F.col("round"), F.col("role"))
    return write_named_files(responses.select(path.alias("path"), F.col("text").alias("body")), root)


def read_response_tree(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Answer files of one run directory as (scenario, case_idx, role, round, path, text).

    cooperation: `<root>/<idx>/round<n>/{meta,reasoner}/raw_responses.txt`; scenario is null there.
    competition: `<root>/<scenario>_analysis_{Meta,Reasoner}_<idx>/raw_responses.txt`; the directory
    called Reasoner holds the verifier's answer.
    """
    depth = {"cooperation": "*/round*/*", "competition": "*"}[layout]
    raw = (
        spark.read.option("pathGlobFilter", "raw_responses*.txt")
        .text(f"{root}/{depth}", wholetext=True)
        .select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    )
    if layout == "cooperation":
        pattern = r"/(\d+)/round(\d+)/([^/]+)/[^/]+$"
        return raw.select(
            F.lit(None).cast("string").alias("scenario"),
            F.regexp_extract("path", pattern, 1).try_cast("bigint").alias("case_idx"),
            F.regexp_extract("path", pattern, 3).alias("role"),
            F.regexp_extract("path", pattern, 2).try_cast("int").alias("round"),
            "path",
            "text",
        )
    pattern = r"/([^/]+)_analysis_(Meta|Reasoner)_(\d+)/[^/]+$"
    return raw.select(
        F.regexp_extract("path", pattern, 1).alias("scenario"),
        F.regexp_extract("path", pattern, 3).try_cast("bigint").alias("case_idx"),
        F.when(F.regexp_extract("path", pattern, 2) == "Reasoner", "verifier").otherwise("competition").alias("role"),
        F.lit(None).cast("int").alias("round"),
        "path",
        "text",
    )
