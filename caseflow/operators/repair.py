"""Repair of failed cases: select, plan, merge reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators.problems import Checked, check_cases
from caseflow.scale import with_position

KEY = ["scenario", "case_idx"]


def is_failed(include_text_fallback: bool = False) -> Column:
    """Empty ranking, a failure strategy, or (optionally) a ranking found only by text mentions."""
    strategy = F.coalesce(F.col("parse_strategy"), F.lit(""))
    failed = (F.coalesce(F.size("pred_rc"), F.lit(0)) <= 0) | strategy.isin(*vocab.FAILURES)
    return failed | strategy.contains(vocab.TEXT_FALLBACK) if include_text_fallback else failed


def failed_cases(predictions: DataFrame, include_text_fallback: bool = False) -> DataFrame:
    return predictions.filter(is_failed(include_text_fallback))


def rerun_plan(failed: DataFrame, batch_size: int = vocab.BATCH_SIZE) -> DataFrame:
    """Distinct failed indices per (scenario, alarm_type) in batches of at most `batch_size`.

    The indices of one scenario can be many, so they are listed per batch, never in one row.
    """
    scenario = F.coalesce("scenario", "alarm_type")
    keys = ["scenario", "alarm_type"]
    distinct = failed.select(
        scenario.alias("scenario"), F.coalesce("alarm_type", scenario).alias("alarm_type"), F.col("case_idx").alias("idx")
    ).distinct()
    placed = with_position(distinct, keys, "idx")
    return (
        placed.withColumn("batch", F.expr(f"(position - 1) div {batch_size}L"))
        .groupBy(*keys, "batch")
        .agg(F.array_sort(F.collect_list("idx")).alias("indices"))
    )


def checked_reruns(failed: DataFrame, batch_size: int = vocab.BATCH_SIZE) -> Checked:
    """The plan of `rerun_plan`, and the failed rows that are not in it on their own, each with a reason.

    A row without index or without scenario and alarm type cannot be asked again; of rows that repeat an index the
    first is planned. The numbers of planned indices and of problems add up to the failed rows.
    """
    scenario = F.coalesce("scenario", "alarm_type")
    named = failed.withColumns({"scenario": scenario, "alarm_type": F.coalesce("alarm_type", scenario)})
    checked = check_cases(named, ["scenario", "alarm_type"], "case_idx")
    return Checked(rerun_plan(checked.accepted, batch_size), checked.problems)


def merge_reruns(baseline: DataFrame, replacements: DataFrame, order: str = "seq") -> DataFrame:
    """Baseline with rows replaced by (scenario, case_idx); the last replacement by `order` wins.

    Replacements without a baseline row are ignored. Adds `rerun`. Keys are unique on both sides after
    the pre-aggregation, so the join has no hot key.
    """
    values = [c for c in baseline.columns if c not in KEY]
    latest = replacements.groupBy(*KEY).agg(F.max_by(F.struct(*values), F.col(order)).alias("new"))
    merged = baseline.join(latest, KEY, "left")
    found = F.col("new").isNotNull()
    return merged.select(
        *KEY, *[F.when(found, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in values], found.alias("rerun")
    )


def mark_rerun(parsed: DataFrame) -> DataFrame:
    """Prefix the strategy of re-parsed answers; a failed inference keeps its own name."""
    strategy = F.col("parse_strategy")
    return parsed.withColumn(
        "parse_strategy",
        F.when(strategy == vocab.RERUN_FAILED, strategy).otherwise(F.concat(F.lit("rerun:"), strategy)),
    )


def rerun_counters(requested: DataFrame, reruns: DataFrame, merged: DataFrame, key: str = "method") -> DataFrame:
    """Counters of a repair run per method: requested, rerun (parsed / unparsed), final."""

    def count(df: DataFrame, what: str) -> DataFrame:
        parsed = F.size("pred_rc") > 0
        return df.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"{what}_count"),
            F.count_if(parsed).alias(f"{what}_parsed_count"),
            F.count_if(~parsed).alias(f"{what}_unparsed_count"),
        )

    counted = (
        count(merged, "final").join(count(requested, "requested"), key, "left").join(count(reruns, "rerun"), key, "left")
    )

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    return counted.select(
        key,
        F.col("final_count").alias("processed_count"),
        zero("requested_count"),
        zero("rerun_count"),
        zero("rerun_parsed_count"),
        zero("rerun_unparsed_count"),
        "final_unparsed_count",
    )


def all_runs(baseline_runs: DataFrame, rerun_runs: DataFrame) -> DataFrame:
    """Run rows of both, so that elapsed time adds up."""
    return baseline_runs.unionByName(rerun_runs)
