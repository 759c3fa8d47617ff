"""Selection of new cases by an index checkpoint, windows over the case index, and stages.

A case is one (scenario, idx) row, idx is unique in its scenario. One scenario may hold a large part of
all cases, so positions come from `with_position` and totals from map-side combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.scale import same_key_join, with_position

CHECKPOINT_KEY = ["folder", "mode"]


# --- checkpoints ------------------------------------------------------------------------------
def upsert_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row per (folder, mode) of two checkpoint tables."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in CHECKPOINT_KEY]
    return (
        both.groupBy(*CHECKPOINT_KEY)
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "last_index")).alias("row"))
        .select(*CHECKPOINT_KEY, "row.*")
    )


def last_indices(checkpoints: DataFrame, mode: str) -> DataFrame:
    """(scenario, last_index) of one mode; the folder is the scenario directory."""
    return checkpoints.filter(F.col("mode") == mode).select(F.col("folder").alias("scenario"), "last_index")


def select_new(
    cases: DataFrame,
    checkpoints: DataFrame,
    mode: str,
    *,
    reset: bool = False,
    initial: int = vocab.INITIAL_LAST_INDEX,
    max_new: int | None = None,
) -> DataFrame:
    """Cases above their scenario's checkpoint, at most `max_new` lowest ones per scenario.

    Adds `previous_last_index`. The checkpoint table has one row per folder and mode; it carries no
    broadcast hint, so Spark broadcasts it only below its size threshold and otherwise splits skewed
    partitions of the join.
    """
    if max_new is not None and max_new <= 0:
        raise ValueError("max_new must be positive")
    if reset:
        chosen = cases.withColumn("previous_last_index", F.lit(initial).cast("bigint"))
    else:
        chosen = (
            cases.join(last_indices(checkpoints, mode), "scenario", "left")
            .withColumn("previous_last_index", F.coalesce(F.col("last_index"), F.lit(initial)).cast("bigint"))
            .drop("last_index")
        )
    chosen = chosen.filter(F.col("idx") > F.col("previous_last_index"))
    if max_new is None:
        return chosen
    return with_position(chosen, ["scenario"], "idx", first=max_new).drop("position", "group_n")


def select_window(cases: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Half-open window [start, end) for manual runs; an open end keeps everything on that side.

    A plain filter that reaches the scan. Such a run never moves the checkpoint.
    """
    kept = cases
    if start is not None:
        kept = kept.filter(F.col("idx") >= start)
    if end is not None:
        kept = kept.filter(F.col("idx") < end)
    return kept


def window_plan(cases: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Per scenario: effective bounds, number of selected cases and `previous_last_index` = start - 1."""
    low = F.coalesce(F.lit(start).cast("bigint"), F.min("idx"))
    high = F.coalesce(F.lit(end).cast("bigint"), F.max("idx") + 1)
    inside = (F.col("idx") >= (start if start is not None else F.col("idx"))) & (
        F.col("idx") < (end if end is not None else F.col("idx") + 1)
    )
    return cases.groupBy("scenario").agg(
        low.alias("window_start"),
        high.alias("window_end"),
        F.count_if(inside).alias("selected_count"),
        (low - 1).alias("previous_last_index"),
    )


def advance(outcomes: DataFrame, previous: DataFrame) -> DataFrame:
    """New checkpoint per scenario: the last selected idx before the first failed one.

    `outcomes` has scenario, idx, ok; `previous` has scenario, previous_last_index. Gaps in the numbering
    do not block, a failure does. The first failure is found first (one row per scenario), then only rows
    below it count; both passes are combined on the map side.
    """
    failed = outcomes.filter(~F.coalesce(F.col("ok"), F.lit(False)))
    first_failed = failed.groupBy("scenario").agg(F.min("idx").alias("first_failed"))
    reached = (
        outcomes.join(first_failed, "scenario", "left")
        .filter(F.col("first_failed").isNull() | (F.col("idx") < F.col("first_failed")))
        .groupBy("scenario")
        .agg(F.max("idx").alias("reached"))
    )
    return (
        previous.join(reached, "scenario", "left")
        .join(first_failed, "scenario", "left")
        .select(
            "scenario",
            "previous_last_index",
            F.coalesce("reached", "previous_last_index").alias("last_index"),
            "first_failed",
        )
    )


# --- batches, blocks, windows -----------------------------------------------------------------
def with_batch(cases: DataFrame, size: int, keys=("scenario",)) -> DataFrame:
    """Batch number (from 0) of `size` consecutive cases per scenario."""
    if size <= 0:
        raise ValueError("size must be positive")
    placed = with_position(cases, list(keys), "idx")
    return placed.withColumn("batch", F.expr(f"(position - 1) div {size}L")).drop("position", "group_n")


def id_range(cases: DataFrame, start: int, end: int) -> DataFrame:
    return select_window(cases, start, end)


def last_cases(cases: DataFrame, m: int) -> DataFrame:
    return with_position(cases, ["scenario"], "idx", last=m).drop("position", "group_n")


def with_block(cases: DataFrame, limit: int, size: int) -> DataFrame:
    """Blocks of `size` cases below index `limit`; the last block may be short."""
    return with_batch(cases.filter(F.col("idx") < limit), size).withColumnRenamed("batch", "block")


def trailing_train_window(cases: DataFrame, infer: DataFrame, train_n: int = vocab.TRAIN_N) -> DataFrame:
    """The last `train_n` existing cases before the first inferred idx of each scenario.

    Adds `train_available`; rows of a scenario with fewer than `train_n` are returned too, and
    `short_train_windows` lists those scenarios.
    """
    first_infer = infer.groupBy("scenario").agg(F.min("idx").alias("first_infer"))
    earlier = cases.join(first_infer, "scenario").filter(F.col("idx") < F.col("first_infer"))
    placed = with_position(earlier, ["scenario"], "idx", last=train_n)
    return placed.withColumn("train_available", F.least(F.col("group_n"), F.lit(train_n))).drop("position", "group_n")


def short_train_windows(train: DataFrame, infer: DataFrame, train_n: int = vocab.TRAIN_N) -> DataFrame:
    """Scenarios whose window has fewer than `train_n` cases, none at all included."""
    have = train.groupBy("scenario").agg(F.count(F.lit(1)).alias("available"))
    return (
        infer.select("scenario").distinct().join(have, "scenario", "left")
        .select("scenario", F.coalesce("available", F.lit(0)).alias("available"))
        .filter(F.col("available") < train_n)
    )


def stage_specs(cases: DataFrame, block_size: int) -> DataFrame:
    """Expanding-window stages: block k is inferred, all earlier blocks train.

    One row per stage with index bounds instead of one row per (stage, train case), which would grow with
    the square of the cases. Training of a stage is `idx <= train_last_idx`.
    """
    placed = with_position(cases.select("scenario", "idx"), ["scenario"], "idx")
    blocks = (
        placed.withColumn("block", F.expr(f"(position - 1) div {block_size}L"))
        .groupBy("scenario", "block")
        .agg(
            F.min("idx").alias("infer_first_idx"),
            F.max("idx").alias("infer_last_idx"),
            F.count(F.lit(1)).alias("infer_n"),
            F.max("group_n").alias("group_n"),
        )
    )
    previous = blocks.select("scenario", (F.col("block") + 1).alias("block"), F.col("infer_last_idx").alias("train_last_idx"))
    return (
        blocks.filter((F.col("block") > 0) & (F.col("group_n") >= 2 * block_size))
        .transform(same_key_join, previous, ["scenario", "block"])
        .select(
            "scenario",
            F.col("block").cast("int").alias("stage"),
            (F.col("block") * block_size).alias("train_n"),
            "train_last_idx",
            "infer_n",
            "infer_first_idx",
            "infer_last_idx",
        )
    )


def with_stages(cases: DataFrame, block_size: int) -> DataFrame:
    """Rows of every stage with `part` = train / infer, for the tree jobs.

    A case of block b is inferred in stage b and trains all later stages, so its stages follow from its
    position and no join with a stage table is needed. The output is one row per (stage, case) by definition;
    the caller's window bounds the number of stages.
    """
    placed = with_position(cases, ["scenario"], "idx").filter(F.col("group_n") >= 2 * block_size)
    block, last = F.expr(f"(position - 1) div {block_size}L"), F.expr(f"(group_n - 1) div {block_size}L")
    stages = F.sequence(F.greatest(block, F.lit(1)), last).cast("array<int>")
    expanded = placed.select(*cases.columns, block.alias("_block"), F.explode(stages).alias("stage"))
    return expanded.withColumn("part", F.when(F.col("stage") == F.col("_block"), "infer").otherwise("train")).drop("_block")


def stage_summary(cases: DataFrame, block_size: int) -> DataFrame:
    """Size and bounds of both parts of every stage, from one row per block and running sums.

    Unlike `with_stages` this never repeats a case, so it is linear in the cases.
    """
    placed = with_position(cases.select("scenario", "idx"), ["scenario"], "idx").filter(F.col("group_n") >= 2 * block_size)
    blocks = placed.groupBy("scenario", F.expr(f"CAST((position - 1) div {block_size}L AS INT)").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )
    earlier = Window.partitionBy("scenario").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)  # over blocks
    train = blocks.select(
        "scenario", "stage", F.lit("train").alias("part"), F.sum("n").over(earlier).alias("n"),
        F.min("first_idx").over(earlier).alias("first_idx"), F.max("last_idx").over(earlier).alias("last_idx"),
    )
    infer = blocks.select("scenario", "stage", F.lit("infer").alias("part"), "n", "first_idx", "last_idx")
    return infer.unionByName(train).filter("stage > 0")


# --- validation -------------------------------------------------------------------------------
def window_counts(cases: DataFrame, start: int, end: int, expected: int) -> DataFrame:
    """Cases per scenario in the closed interval, and whether that is the expected number."""
    inside = F.col("idx").between(start, end)
    return cases.groupBy("scenario").agg(F.count_if(inside).alias("case_count")).withColumn(
        "as_expected", F.col("case_count") == expected
    )


def gap_ranges(cases: DataFrame, start: int, end: int) -> DataFrame:
    """Missing index ranges per scenario in the closed interval [start, end].

    Neighbours give the gaps, so the full range is never generated and no anti join is needed.
    """
    inside = cases.select("scenario", "idx").filter(F.col("idx").between(start, end))
    ordered = with_position(inside, ["scenario"], "idx", previous=True)
    inner = ordered.select(
        "scenario",
        F.coalesce(F.col("previous_idx") + 1, F.lit(start)).cast("bigint").alias("gap_start"),
        (F.col("idx") - 1).cast("bigint").alias("gap_end"),
    )
    tail = inside.groupBy("scenario").agg((F.max("idx") + 1).cast("bigint").alias("gap_start")).withColumn(
        "gap_end", F.lit(end).cast("bigint")
    )
    seen = cases.groupBy("scenario").agg(F.count_if(F.col("idx").between(start, end)).alias("n")).filter("n = 0")
    empty = seen.select("scenario", F.lit(start).cast("bigint").alias("gap_start"), F.lit(end).cast("bigint").alias("gap_end"))
    return inner.unionByName(tail).unionByName(empty).filter(F.col("gap_start") <= F.col("gap_end"))


def missing_indices(cases: DataFrame, start: int, end: int, chunk: int = 65536) -> DataFrame:
    """Missing indices one per row; long gaps are first cut in chunks so no row holds a long array."""
    chunks = gap_ranges(cases, start, end).select(
        "scenario", "gap_end", F.explode(F.sequence("gap_start", "gap_end", F.lit(chunk).cast("bigint"))).alias("from")
    )
    upto = F.least(F.col("gap_end"), F.col("from") + chunk - 1)
    return chunks.select("scenario", F.explode(F.sequence("from", upto)).alias("idx"))
