"""Binned trees: the approximate form of `tree.fit` for large training windows.

Exact split search moves every distinct value of every feature once per level. Here the values of a key and feature
are cut into at most `bins` bins before growing, and a level counts rows per (node, feature, bin, class), so that what
moves is bounded by nodes x features x bins x classes, whatever the number of rows.

Cuts come from mergeable summaries: one aggregate per (key, feature) estimates the number of distinct values and the
quantiles. A feature with at most `bins` distinct values gets a bin for each of them, and its splits are the exact
ones. Other features can only be split between bins, so a split may miss the best place by up to one bin's share of
the rows; the threshold itself is still the middle between the neighbouring values of the node, because bins keep
their least and greatest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators.tree import grow
from caseflow.scale import materialize

BINS = 64
# The estimate of distinct values is off by a few percent; features near the limit are counted exactly.
DOUBTFUL = 2


def _value(column: Column) -> Column:
    """Values as 32-bit floats, null as 0, like in exact training and in prediction."""
    return F.coalesce(column.cast("float").cast("double"), F.lit(0.0))


def bin_edges(train: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """(keys, feature, edges, exact): greatest values of the bins, ascending; `exact` when every value has its own.

    Summaries are combined on the map side; the second pass lists values only of features that the first one found
    to have few, and is bounded by a small multiple of `bins` rows per (key, feature).
    """
    if bins < 2:
        raise ValueError("a binned tree needs at least two bins")
    keys = list(keys)
    group = [*keys, "feature"]
    long = train.select(*keys, F.posexplode("features").alias("feature", "value")).withColumn("value", _value(F.col("value")))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    summary = materialize(
        long.groupBy(*group).agg(
            F.approx_count_distinct("value").alias("about"),
            F.percentile_approx("value", shares, F.lit(100 * bins)).alias("quantiles"),
            F.max("value").alias("greatest"),
        ),
        "summaries",
    )
    few = summary.filter(F.col("about") <= DOUBTFUL * bins).select(*group)
    values = long.join(few, group, "left_semi").select(*group, "value").distinct()
    listed = values.groupBy(*group).agg(F.sort_array(F.collect_list("value")).alias("all")).filter(F.size("all") <= bins)
    quantiles = F.array_sort(F.array_distinct(F.concat(F.slice("quantiles", 1, bins - 1), F.array("greatest"))))
    return summary.join(listed, group, "left").select(
        *group, F.coalesce("all", quantiles).alias("edges"), F.col("all").isNotNull().alias("exact")
    )


def bin_of(edges: Column, value: Column, bins: int = BINS) -> Column:
    """Number of edges below `value`: the bin whose greatest value is the first not below it.

    A value that is an edge, as all are where every value has its own bin, is looked up at once, others by halving.
    A value above all edges, which training rows never have, falls into the last bin.
    """
    steps = F.sequence(F.lit(1), F.lit(bins.bit_length() + 1))

    def halve(range_: Column, _step: Column) -> Column:
        lo, hi = range_["lo"], range_["hi"]
        middle = ((lo + hi) / 2).cast("int")
        above = F.get(edges, middle) < value
        return F.when(lo >= hi, range_).otherwise(
            F.struct(F.when(above, middle + 1).otherwise(lo).cast("int").alias("lo"), F.when(above, hi).otherwise(middle).cast("int").alias("hi"))
        )

    whole = F.struct(F.lit(0).cast("int").alias("lo"), (F.size(edges) - 1).cast("int").alias("hi"))
    place = F.array_position(edges, value)
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.aggregate(steps, whole, halve, lambda r: r["lo"]))


def with_bins(rows: DataFrame, edges: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """Add `bins`, the bin of every feature. The edges of a key are one row: features x bins numbers."""
    keys = list(keys)
    entry = F.struct("feature", "edges")
    by_key = edges.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["edges"]).alias("_edges"))
    found = F.transform("features", lambda value, i: bin_of(F.get("_edges", i), _value(value), bins))
    return rows.join(materialize(by_key, "edges"), keys).withColumn("bins", found).drop("_edges")


def bin_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, least and greatest value per (key, node, feature, bin, label); combined on the map side."""
    pairs = F.arrays_zip(F.col("features").alias("value"), F.col("bins").alias("bin"))
    long = rows.select(*keys, "node", "label", F.posexplode(pairs).alias("feature", "p"))
    value = _value(F.col("p.value"))
    return long.groupBy(*keys, "node", "feature", F.col("p.bin").alias("bin"), "label").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def best_bin_splits(counts: DataFrame, totals: DataFrame, keys: Sequence[str], min_leaf: int) -> DataFrame:
    """Best split between bins per (key, node), by the running sums of `tree.best_splits`.

    A node and feature has at most bins x classes rows here, so plain windows do.
    """
    group = [*keys, "node", "feature"]
    whole = Window.partitionBy(*keys, "node")
    class_n = F.col("n").cast("double")
    class_total = totals.select(
        *keys, "node", "label", class_n.alias("class_n"), F.sum(class_n).over(whole).alias("node_n"), F.sum(class_n * class_n).over(whole).alias("node_squares")
    )
    n = F.col("n")
    before = F.sum(n).over(Window.partitionBy(*group, "label").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - n
    steps = counts.join(class_total, [*keys, "node", "label"]).withColumn("before", before)
    per_bin = steps.groupBy(*group, "bin").agg(
        F.sum(n).alias("n"),
        F.sum(2 * F.col("before") * n + n * n).alias("left"),
        F.sum(n * n - 2 * (F.col("class_n") - F.col("before")) * n).alias("right"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.max("node_n").alias("node_n"),
        F.max("node_squares").alias("node_squares"),
    )
    in_order = Window.partitionBy(*group).orderBy("bin")
    to_here = in_order.rowsBetween(Window.unboundedPreceding, 0)
    running = per_bin.select(
        *group,
        *[F.sum(c).over(to_here).alias(c) for c in ("n", "left", "right")],
        "greatest",
        F.lead("least").over(in_order).alias("following"),
        "node_n",
        "node_squares",
    )
    left_n, right_n = F.col("n"), F.col("node_n") - F.col("n")
    scored = running.filter(F.col("following").isNotNull() & (left_n >= min_leaf) & (right_n >= min_leaf)).select(
        *group,
        (F.col("left") / left_n + (F.col("node_squares") + F.col("right")) / right_n).alias("score"),
        ((F.col("greatest") + F.col("following")) / 2).alias("threshold"),
        "greatest",
    )
    order = F.struct(F.col("score"), (-F.col("feature")).alias("feature"), (-F.col("greatest")).alias("value"), F.col("threshold"))
    return scored.groupBy(*keys, "node").agg(F.max(order).alias("best")).select(
        *keys, "node", (-F.col("best.feature")).alias("feature"), F.col("best.threshold").alias("threshold")
    )


def fit(
    train: DataFrame,
    keys: Sequence[str],
    *,
    bins: int = BINS,
    max_depth: int = vocab.MAX_DEPTH,
    min_leaf: int = vocab.MIN_SAMPLES_LEAF,
) -> DataFrame:
    """Grow one binned tree per key; the same input and node table as `tree.fit`.

    Equal to `tree.fit` where no feature has more than `bins` distinct values in a key; otherwise approximate.
    """
    keys = list(keys)
    given = train.select(*keys, "features", "label")
    rows = with_bins(given, bin_edges(given, keys, bins), keys, bins)
    return grow(rows, keys, lambda searched, totals: best_bin_splits(bin_counts(searched, keys), totals, keys, min_leaf), max_depth, min_leaf)
