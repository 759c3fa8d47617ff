"""Ranking evaluation: truth ranks, Top-k, MRR, per scenario and overall, by halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.ranking import truth_rank
from caseflow.functions.text import clean_distinct, strip
from caseflow.scale import materialize, with_position, without_order

OVERALL = "overall"
HALVES = ("first_100", "last_100")
NO_INDEX = "no_index"


def rank_predictions(predictions: DataFrame) -> DataFrame:
    """Clean `pred_rc`, then add pred_top1_rc, rank (null on a miss) and is_correct. Row-wise."""
    cleaned = predictions.withColumn("pred_rc", clean_distinct(F.col("pred_rc"))).withColumn(
        "groundtruth", F.coalesce(strip(F.col("groundtruth")), F.lit(""))
    )
    rank = truth_rank(F.col("pred_rc"), F.col("groundtruth"))
    return (
        cleaned.withColumn("pred_top1_rc", F.try_element_at("pred_rc", F.lit(1)))
        .withColumn("rank", rank)
        .withColumn("is_correct", F.coalesce(F.col("rank") == 1, F.lit(False)))
    )


def metric_sums() -> list[Column]:
    """Additive parts of the metrics; they combine on the map side and roll up without a second scan."""
    labelled = F.coalesce(F.col("groundtruth") != "", F.lit(False))
    rank = F.col("rank")
    return [
        F.count_if(labelled).alias("evaluated_count"),
        *[F.count_if(labelled & (rank <= k)).alias(f"hit{k}") for k in (1, 3, 5)],
        F.coalesce(F.sum(F.when(labelled & (rank > 0), 1.0 / rank)), F.lit(0.0)).alias("reciprocal"),
        F.count_if(labelled & (F.col("parse_strategy") == vocab.UNPARSED)).alias("unparsed_count"),
    ]


SUM_COLUMNS = ("evaluated_count", "hit1", "hit3", "hit5", "reciprocal", "unparsed_count")


def ratios(sums: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Metric columns from additive parts; null ratios when nothing is labelled."""
    n = F.nullif(F.col("evaluated_count"), F.lit(0))
    return sums.select(
        *keys,
        "evaluated_count",
        (F.col("hit1") / n).alias("top1"),
        (F.col("hit3") / n).alias("top3"),
        (F.col("hit5") / n).alias("top5"),
        (F.col("reciprocal") / n).alias("mrr"),
        *(extra or []),
        "unparsed_count",
    )


def roll_up(parts: DataFrame, keys: list[str], sums) -> DataFrame:
    """Add an `overall` row over all scopes (`_all` marks it).

    `parts` is already aggregated, one row per scope; each row counts for its scope and for the whole, so the
    big table below is read once.
    """
    scopes = F.array(
        F.struct(F.col("scope"), F.lit(False).alias("all")), F.struct(F.lit(OVERALL).alias("scope"), F.lit(True).alias("all"))
    )
    both = parts.withColumn("_s", F.explode(scopes)).select(*keys, "_s.scope", F.col("_s.all").alias("_all"), *sums)
    return both.groupBy(*keys, "scope", "_all").agg(*[F.sum(c).alias(c) for c in sums])


def leaderboard(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """Metrics per (method, scenario) and overall per method, with summed run times.

    The big table is aggregated once; `overall` is summed from those few rows instead of expanding every
    input row into two grouping sets. Run times come from `runs` (method, scenario, elapsed_seconds).
    """
    keys = ["method"]
    parts = ranked.groupBy("method", F.col("scenario").alias("scope")).agg(*metric_sums())
    times = runs.groupBy("method", F.col("scenario").alias("scope")).agg(F.sum("elapsed_seconds").alias("elapsed_seconds"))
    scored = roll_up(parts, keys, SUM_COLUMNS).join(roll_up(times, keys, ["elapsed_seconds"]), ["method", "scope", "_all"], "left")
    scored = scored.withColumn("elapsed_seconds", F.coalesce("elapsed_seconds", F.lit(0.0)))
    average = F.col("elapsed_seconds") / F.nullif(F.col("evaluated_count"), F.lit(0))
    return ratios(
        scored, ["method", "scope"], [F.col("elapsed_seconds"), average.alias("average_seconds_per_case")]
    )


def half_metrics(ranked: DataFrame) -> DataFrame:
    """Metrics of the first and second half of each scenario by index, and of the halves over all.

    The first half has floor(n/2) cases. Cases without an index have no half and count under NO_INDEX. The narrow rows
    are written once, because counting and numbering both read them.
    """
    narrow = ranked.select("method", "scenario", F.col("case_idx").alias("idx"), "groundtruth", "rank", "parse_strategy")
    narrow = materialize(narrow, "ranked")
    placed = with_position(narrow, ["method", "scenario"], "idx")
    half = F.when(F.col("position") <= F.expr("group_n div 2"), HALVES[0]).otherwise(HALVES[1])
    columns = ["method", "scenario", "half", "groundtruth", "rank", "parse_strategy"]
    halved = placed.withColumn("half", half).select(*columns)
    lost = without_order(narrow, "idx").withColumn("half", F.lit(NO_INDEX)).select(*columns)
    parts = halved.unionByName(lost).groupBy("method", "half", F.col("scenario").alias("scope")).agg(*metric_sums())
    return ratios(roll_up(parts, ["method", "half"], SUM_COLUMNS), ["method", "scope", "half"])


def parse_summary(ranked: DataFrame, keys=("method",)) -> DataFrame:
    """How many answers gave a ranking and how many did not."""
    parsed = F.size("pred_rc") > 0
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed_count"),
        F.count_if(parsed).alias("parsed_count"),
        F.count_if(~parsed).alias("unparsed_count"),
    )


def accuracy(predictions: DataFrame, keys) -> DataFrame:
    """Labelled total, correct and accuracy; rows with null is_correct are not labelled."""
    return predictions.groupBy(*keys).agg(
        F.count("is_correct").alias("labeled_total"),
        F.count_if("is_correct").alias("correct"),
        F.avg(F.col("is_correct").cast("int")).alias("accuracy"),
    )
