"""Ranked answers out of model responses: parse, pick the deciding response, rank against the truth.

Parsing is row-wise over whole texts; only one response per case takes part in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.ranking import all_rankings, best_ranking, mention_ranking
from caseflow.functions.text import after_think
from caseflow.operators.evaluate import rank_predictions

CASE = ["scenario", "case_idx"]


def parse_answers(
    responses: DataFrame,
    *,
    text: str = "text",
    candidates: str = "candidates",
    allow_text: bool = True,
    after_think_only: bool = False,
) -> DataFrame:
    """Add pred_rc, parse_strategy and ranking_count.

    Policy: the best structured array, else (if allowed) the order of first mention, else `unparsed`. A
    null text is unparsed.
    """
    subject = after_think(F.col(text)) if after_think_only else F.col(text)
    found = responses.withColumn("_rankings", all_rankings(subject, F.col(candidates)))
    fallback = mention_ranking(F.col(text), F.col(candidates)) if allow_text else F.lit(None).cast("array<string>")
    scored = found.withColumn("_best", best_ranking(F.col("_rankings"))).withColumn(
        "_mention", F.when(F.col("_best").isNull(), fallback)
    )
    return (
        scored.withColumn("ranking_count", F.coalesce(F.size("_rankings"), F.lit(0)))
        .withColumn("ranking_count", F.greatest("ranking_count", F.lit(0)))
        .withColumn("pred_rc", F.coalesce("_best", "_mention", F.array().cast("array<string>")))
        .withColumn(
            "parse_strategy",
            F.when(F.col("_best").isNotNull(), vocab.STRUCTURED)
            .when(F.col("_mention").isNotNull(), vocab.TEXT_FALLBACK)
            .otherwise(vocab.UNPARSED),
        )
        .drop("_rankings", "_best", "_mention")
    )


def with_attempts(parsed: DataFrame, source: Column, round_id: Column, path: Column, text: str = "text") -> DataFrame:
    """Add `parse_attempts`: the structured attempt, and the one with text fallback if that failed."""
    exists = F.col(text).isNotNull()
    strategy = F.col("parse_strategy")

    def attempt(result: Column) -> Column:
        return F.struct(
            source.alias("source"),
            round_id.cast("int").alias("round"),
            path.alias("path"),
            exists.alias("exists"),
            result.alias("strategy"),
            F.col("ranking_count").alias("ranking_count"),
        )

    first = attempt(F.when(strategy == vocab.STRUCTURED, strategy))
    second = attempt(F.when(strategy == vocab.TEXT_FALLBACK, strategy))
    return parsed.withColumn(
        "parse_attempts", F.when(strategy == vocab.STRUCTURED, F.array(first)).otherwise(F.array(first, second))
    )


def _labelled(parsed: DataFrame, prefix: Column) -> DataFrame:
    strategy = F.col("parse_strategy")
    return parsed.withColumn(
        "parse_strategy", F.when(strategy == vocab.UNPARSED, strategy).otherwise(F.concat(prefix, strategy))
    )


def _path(df: DataFrame) -> Column:
    return F.col("path") if "path" in df.columns else F.lit(None).cast("string")


def parse_competition(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Only the verifier's answer decides; a case without one is unparsed."""
    verifier = responses.filter(F.col("role") == "verifier").select(*CASE, "text", _path(responses).alias("path"))
    parsed = parse_answers(cases.join(verifier, CASE, "left"))
    source = F.lit("competition_reasoner")
    logged = with_attempts(parsed, source, F.lit(None), F.col("path"))
    return _labelled(logged, F.concat(source, F.lit(":")))


def last_meta(responses: DataFrame) -> DataFrame:
    """Meta response of the highest round of each case.

    A round counts as soon as it was prepared, so `responses` holds a row with null text for a failed one
    and the case is then unparsed; there is no way back to an earlier round. One combined aggregate.
    """
    meta = responses.filter(F.col("role") == "meta").select(*CASE, "round", "text", _path(responses).alias("path"))
    last = F.max_by(F.struct("round", "text", "path"), F.struct(F.col("round"), F.col("text").isNotNull()))
    return meta.groupBy(*CASE).agg(last.alias("m")).select(*CASE, "m.*")


def parse_cooperation(cases: DataFrame, responses: DataFrame) -> DataFrame:
    parsed = parse_answers(cases.join(last_meta(responses), CASE, "left"))
    logged = with_attempts(parsed, F.lit("cooperation_meta"), F.col("round"), F.col("path"))
    logged = logged.withColumn(
        "parse_attempts", F.when(F.col("round").isNotNull(), F.col("parse_attempts")).otherwise(F.slice("parse_attempts", 1, 0))
    )
    return _labelled(logged, F.concat(F.lit("cooperation_meta:round"), F.col("round").cast("string"), F.lit(":")))


def method_results(cases: DataFrame, responses: DataFrame, method: str) -> DataFrame:
    """Predictions of one method: parse its deciding answers and rank the truth.

    `cases` needs scenario, case_idx, groundtruth and candidates (categories).
    """
    parse = {"competition": parse_competition, "cooperation": parse_cooperation}[method]
    parsed = parse(cases, responses).withColumn("method", F.lit(method))
    return rank_predictions(parsed)


def rescore(predictions: DataFrame, cases: DataFrame, responses: DataFrame, runs: DataFrame, method: str) -> DataFrame:
    """Parse stored answers again and rank them, without new inference.

    A scenario without a run directory (output_dir in `runs`) gets its own strategy and no ranking.
    """
    known = runs.filter((F.col("method") == method) & F.col("output_dir").isNotNull()).select("scenario").distinct()
    wanted = predictions.filter(F.col("method") == method).select(*CASE)
    subject = wanted.join(cases.select(*CASE, "groundtruth", "candidates"), CASE, "left")
    results = method_results(subject, responses, method)
    results = results.join(known.withColumn("_run", F.lit(True)), "scenario", "left")
    gone = F.col("_run").isNull()
    return (
        results.withColumn("parse_strategy", F.when(gone, vocab.MISSING_RUN).otherwise(F.col("parse_strategy")))
        .withColumn("pred_rc", F.when(gone, F.array().cast("array<string>")).otherwise(F.col("pred_rc")))
        .withColumn("pred_top1_rc", F.when(~gone, F.col("pred_top1_rc")))
        .withColumn("rank", F.when(~gone, F.col("rank")))
        .withColumn("is_correct", F.when(gone, F.lit(False)).otherwise(F.col("is_correct")))
        .withColumn("parse_attempts", F.when(gone, F.slice("parse_attempts", 1, 0)).otherwise(F.col("parse_attempts")))
        .drop("_run", "text", "path")
    )
