"""From case documents to tree predictions and a moved checkpoint, for all scenarios in one set of jobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators import features as feat
from caseflow.operators import incremental as inc
from caseflow.operators import tree
from caseflow.operators.problems import check_cases
from caseflow.scale import materialize


class FlowResult(NamedTuple):
    predictions: DataFrame
    nodes: DataFrame
    short_windows: DataFrame
    checkpoints: DataFrame
    problems: DataFrame


def selected_arrays(cases: DataFrame, selections: DataFrame, keep=("scenario", "idx")) -> tuple[DataFrame, list[str]]:
    """Features of every case under its scenario's selection as one array over all feature names.

    Features outside the selection are 0 in the whole scenario, so no tree of it can split on them.
    """
    return feat.selected_values(cases, selections, keep)


def tree_flow(
    cases: DataFrame,
    selections: DataFrame,
    checkpoints: DataFrame,
    *,
    mode: str = "tree_infer",
    label: str = "root_cause",
    train_n: int = vocab.TRAIN_N,
    max_new: int | None = None,
    max_depth: int = vocab.MAX_DEPTH,
    min_leaf: int = vocab.MIN_SAMPLES_LEAF,
) -> FlowResult:
    """New cases of every scenario, predicted by a tree of the labelled cases just before them.

    `cases` (scenario, idx, sem, label) is filtered by plain columns before any document is opened, and the features
    of the chosen cases are written once. A new case without a prediction (its scenario has no earlier
    labelled case) fails, and holds the checkpoint below it. Cases without an index, or with one that another case has,
    are `problems` and take no part.
    """
    plain, problems = check_cases(cases.select("scenario", "idx", F.col(label).alias("_label")), first=["_label"])
    new = materialize(inc.select_new(plain, checkpoints, mode, max_new=max_new), "new")
    labelled = plain.filter(F.col("_label").isNotNull() & (F.col("_label") != ""))
    train = materialize(inc.trailing_train_window(labelled, new, train_n), "train")
    chosen = train.select("scenario", "idx", "_label", F.lit(True).alias("_train")).unionByName(
        new.select("scenario", "idx", "_label", F.lit(False).alias("_train"))
    )
    opened = cases.select("scenario", "idx", "sem").join(chosen, ["scenario", "idx"]).dropDuplicates(["scenario", "idx"])
    arrays, names = selected_arrays(opened, selections, ("scenario", "idx", "_label", "_train"))
    arrays = materialize(arrays.withColumnRenamed("_label", label), "features")
    predictions, nodes = tree.run(
        arrays.filter("_train").drop("_train"), arrays.filter("NOT _train").drop("_train"), ["scenario"], names,
        label=label, max_depth=max_depth, min_leaf=min_leaf,
    )
    predictions = materialize(predictions.drop("features"), "predictions")
    outcomes = new.select("scenario", "idx").join(predictions.select("scenario", "idx", F.lit(True).alias("ok")), ["scenario", "idx"], "left")
    before = new.select("scenario", "previous_last_index").distinct()
    moved = inc.advance(outcomes, before).filter(F.col("last_index") > F.col("previous_last_index"))
    changed = moved.select(
        F.col("scenario").alias("folder"), F.lit(mode).alias("mode"), F.col("scenario").alias("alarm_type"), "last_index",
        F.current_timestamp().alias("updated_at"),
    )
    return FlowResult(predictions, nodes, inc.short_train_windows(train, new, train_n), inc.upsert_checkpoints(checkpoints, changed), problems)
