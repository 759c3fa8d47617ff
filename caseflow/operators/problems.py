"""Case tables that operators number or window, split into accepted rows and a table of problems.

Positions need an index that is there and unique in its group. Rows without one would silently leave batches, windows,
stages and rerun plans, so they are set apart first, each with a reason, and nothing is lost between the two tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.scale import materialize

NO_INDEX, NO_GROUP, REPEATED = "no_index", "no_group", "repeated_index"


class Checked(NamedTuple):
    """`accepted` has the columns of the input, `problems` those and `reason`."""

    accepted: DataFrame
    problems: DataFrame


def check_cases(cases: DataFrame, keys: Sequence[str] = ("scenario",), order: str = "idx", first: Sequence[str] = ()) -> Checked:
    """Rows with a unique `order` in their group, and all others with the first reason that holds.

    `no_index`: `order` is null. `no_group`: all keys are null. `repeated_index`: another row of the group has the same index
    and comes first by the columns `first` (any of them where these tie). The decision is written once, so that the
    two tables complement each other whenever they are read.
    """
    keys = list(keys)
    grouped = F.coalesce(*[F.col(k).cast("string") for k in keys])
    base = F.when(F.col(order).isNull(), NO_INDEX).when(grouped.isNull(), NO_GROUP)
    # Rows without an index are spread by nothing that could be hot: they take no part in the numbering.
    marked = cases.withColumn("reason", base)
    turn = F.row_number().over(Window.partitionBy(*keys, order).orderBy(*(first or [F.lit(0)])))
    sound = marked.filter("reason IS NULL").withColumn("reason", F.when(turn > 1, REPEATED))
    decided = materialize(sound.unionByName(marked.filter("reason IS NOT NULL")), "checked")
    return Checked(decided.filter("reason IS NULL").drop("reason"), decided.filter("reason IS NOT NULL"))


def problem_counts(problems: DataFrame, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    return problems.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def accounted(total: Column, accepted: Column, problems: Column) -> Column:
    """Whether accepted rows and problems add up."""
    return total == F.coalesce(accepted, F.lit(0)) + F.coalesce(problems, F.lit(0))
