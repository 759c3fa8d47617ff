"""Small decision trees (gini, exact splits) grown for all keys at once as DataFrame jobs.

`key` columns (for example scenario and stage) name independent trees; all of them grow in the same
jobs, one level per pass. Training rows are never rewritten: a tree is a map of at most 2^depth nodes in
one row per key, and a row's node is found by walking that map inside the row.

Nodes are numbered like a heap: the root is 1, the children of i are 2i (value <= threshold) and 2i + 1.
Split search per level:
  1. count rows per (key, node, feature, value, class), combined on the map side;
  2. running class counts in value order, through range partitions, so that no task sorts a whole node;
  3. best (feature, threshold) by weighted gini; ties go to the lower feature, then the lower threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.ranking import truth_rank
from caseflow.scale import materialize, range_parts

# Levels below the root that 64-bit heap numbers can name.
MAX_LEVELS = 62
# Known numbers of steps up to here are written out and compiled; their expression has 4 copies of each step before.
WRITTEN_OUT = 3
NODE = "struct<feature:int,threshold:double>"


# --- walking a tree inside a row --------------------------------------------------------------
def node_of(splits: Column, features: Column, depth: int | Column) -> Column:
    """Node a row reaches after at most `depth` splits. `splits` is map<bigint, struct<feature, threshold>>.

    Values are compared as 32-bit floats and null counts as 0, like in training.
    """
    if isinstance(depth, int) and depth <= WRITTEN_OUT:
        node = F.lit(1).cast("bigint")
        for _ in range(depth):
            split = F.try_element_at(splits, node)
            value = F.coalesce(F.get(features, split["feature"]).cast("float").cast("double"), F.lit(0.0))
            node = F.coalesce(node * 2 + (value > split["threshold"]).cast("int"), node)  # no split, no threshold
        return node
    limit = F.lit(depth) if isinstance(depth, int) else depth
    steps = F.slice(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), F.lit(1), limit)

    def step(node: Column, _level: Column) -> Column:
        split = F.try_element_at(splits, node)
        value = F.coalesce(F.get(features, split["feature"]).cast("float").cast("double"), F.lit(0.0))
        goes_right = value > split["threshold"]
        return F.when(split.isNull(), node).otherwise(node * 2 + F.when(goes_right, F.lit(1)).otherwise(F.lit(0)))

    return F.aggregate(steps, F.lit(1).cast("bigint"), step)


def height_of(splits: Column) -> Column:
    """Most splits on a path of the tree: as many steps as a row can take."""
    return F.coalesce(F.array_max(F.transform(F.map_keys(splits), lambda node: level_of(node) + 1)), F.lit(0))


def level_of(node: Column) -> Column:
    """Depth of a heap number (root 0)."""
    return F.length(F.bin(node)) - 1


def path_text(splits: Column, node: Column, names: Sequence[str]) -> Column:
    """`f <= 1.00 -> g > 0.50` from the root to `node`; `(root leaf)` for the root."""
    labels = F.array(*[F.lit(n) for n in names])
    bits = F.bin(node)
    steps = F.sequence(F.lit(1), F.length(bits) - 1)

    def condition(i: Column) -> Column:
        parent = F.conv(F.substring(bits, F.lit(1), i), 2, 10).cast("bigint")
        split = F.try_element_at(splits, parent)
        sign = F.when(F.substring(bits, i + 1, F.lit(1)) == "1", " > ").otherwise(" <= ")
        return F.concat(F.get(labels, split["feature"]), sign, F.format_string("%.2f", split["threshold"]))

    return F.when(node == 1, "(root leaf)").otherwise(F.array_join(F.transform(steps, condition), " -> "))


# --- split search -----------------------------------------------------------------------------
def value_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (key, node, feature, value, label). `rows` has node, features, label."""
    exploded = rows.select(*keys, "node", "label", F.posexplode("features").alias("feature", "value"))
    value = F.coalesce(F.col("value").cast("float").cast("double"), F.lit(0.0))
    return exploded.groupBy(*keys, "node", "feature", value.alias("value"), "label").agg(F.count(F.lit(1)).alias("n"))


def class_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "node", "label").agg(F.count(F.lit(1)).alias("n"))


def best_splits(counts: DataFrame, totals: DataFrame, keys: Sequence[str], min_leaf: int) -> DataFrame:
    """Best split per (key, node): feature and threshold.

    With class counts L, R left and right, minimising the weighted gini equals maximising
    sum(L^2)/n_left + sum(R^2)/n_right. Adding n rows of a class that has l on the left and r on the right
    changes the squares by 2ln + n^2 and n^2 - 2rn, so both sums are running sums in value order. They are
    taken inside a range part; what lies before the part comes from its class totals, a table with one row
    per (part, class). Whole numbers stay exact in doubles up to 2^53.
    """
    group = [*keys, "node", "feature"]
    part = [*group, "_part"]
    parted = range_parts(counts.withColumn("n", F.col("n").cast("double")), [*group, "value"], "value_counts")
    class_n = F.col("n").cast("double")
    whole_node = Window.partitionBy(*keys, "node")  # over the classes of a node
    class_total = totals.select(
        *keys,
        "node",
        "label",
        class_n.alias("class_n"),
        F.sum(class_n).over(whole_node).alias("node_n"),
        F.sum(class_n * class_n).over(whole_node).alias("node_squares"),
    )

    # Per (part, class): rows of the class before the part. Per part: sums before it, next part's first value.
    earlier = Window.partitionBy(*group, "label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = parted.groupBy(*part, "label").agg(F.sum("n").alias("t"), F.min("value").alias("first"))
    class_before = in_part.withColumn("before", F.coalesce(F.sum("t").over(earlier), F.lit(0.0))).join(
        class_total, [*keys, "node", "label"]
    )
    t, before = F.col("t"), F.col("before")
    part_sums = class_before.groupBy(*part).agg(
        F.sum("t").alias("n"),
        F.sum(2 * before * t + t * t).alias("left"),
        F.sum(t * t - 2 * (F.col("class_n") - before) * t).alias("right"),
        F.min("first").alias("first"),
        F.max("node_n").alias("node_n"),
        F.max("node_squares").alias("node_squares"),
    )
    parts_before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part_before = part_sums.select(
        *part,
        *[F.coalesce(F.sum(c).over(parts_before), F.lit(0.0)).alias(f"{c}_before") for c in ("n", "left", "right")],
        F.lead("first").over(Window.partitionBy(*group).orderBy("_part")).alias("following"),
        "node_n",
        "node_squares",
    )

    # Inside the parts: one exchange serves the class windows, the value sums and the value windows.
    spread = parted.repartition(*part).join(class_before.select(*part, "label", "before", "class_n"), [*part, "label"])
    so_far = Window.partitionBy(*part, "label").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("n")
    steps = spread.withColumn("before", F.col("before") + F.sum("n").over(so_far) - n)
    per_value = steps.groupBy(*part, "value").agg(
        F.sum("n").alias("n"),
        F.sum(2 * F.col("before") * n + n * n).alias("left"),
        F.sum(n * n - 2 * (F.col("class_n") - F.col("before")) * n).alias("right"),
    )
    in_order = Window.partitionBy(*part).orderBy("value")
    to_here = in_order.rowsBetween(Window.unboundedPreceding, 0)
    running = per_value.join(part_before, part).select(
        *group,
        "value",
        *[(F.col(f"{c}_before") + F.sum(c).over(to_here)).alias(c) for c in ("n", "left", "right")],
        F.coalesce(F.lead("value").over(in_order), F.col("following")).alias("next_value"),
        "node_n",
        "node_squares",
    )
    left_n, right_n = F.col("n"), F.col("node_n") - F.col("n")
    scored = (
        running.filter(F.col("next_value").isNotNull() & (left_n >= min_leaf) & (right_n >= min_leaf))
        .withColumn("score", F.col("left") / left_n + (F.col("node_squares") + F.col("right")) / right_n)
        .withColumn("threshold", (F.col("value") + F.col("next_value")) / 2)
    )
    order = F.struct(
        F.col("score"), (-F.col("feature")).alias("feature"), (-F.col("value")).alias("value"), F.col("threshold")
    )
    return scored.groupBy(*keys, "node").agg(F.max(order).alias("best")).select(
        *keys, "node", (-F.col("best.feature")).alias("feature"), F.col("best.threshold").alias("threshold")
    )


# --- growing ----------------------------------------------------------------------------------
def as_maps(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its splits as a map; at most 2^depth entries."""
    entry = F.struct("node", F.struct("feature", "threshold").cast(NODE).alias("split"))
    return splits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("splits"))


def _at_nodes(rows: DataFrame, splits: DataFrame | None, keys: Sequence[str], depth: int) -> DataFrame:
    """Rows whose node is on level `depth`; rows that stopped in a leaf above it are left out."""
    if splits is None:
        return rows.withColumn("node", F.lit(1).cast("bigint"))
    joined = rows.join(as_maps(splits, keys), list(keys))
    placed = joined.withColumn("node", node_of(F.col("splits"), F.col("features"), depth)).drop("splits")
    return placed.filter(F.col("node") >= 2**depth)


def fit(
    train: DataFrame,
    keys: Sequence[str],
    *,
    max_depth: int = vocab.MAX_DEPTH,
    min_leaf: int = vocab.MIN_SAMPLES_LEAF,
) -> DataFrame:
    """Grow one tree per key. `train` has the keys, features (array<double>) and label (non-empty).

    Returns the node table: keys, node, feature, threshold (null in leaves), n, dist. `dist` holds every
    class of the key with its count at the node, most frequent first, then by name. Splits need impurity,
    `2 * min_leaf` rows and two sides of `min_leaf` rows. Counts and splits of each level are written to the
    shared folder, so the plan does not grow with the depth.
    """
    keys = list(keys)
    rows = train.select(*keys, "features", "label")
    return grow(rows, keys, lambda searched, totals: best_splits(value_counts(searched, keys), totals, keys, min_leaf), max_depth, min_leaf)


def grow(rows: DataFrame, keys: list[str], search: Callable[[DataFrame, DataFrame], DataFrame], max_depth: int, min_leaf: int) -> DataFrame:
    """Node table of trees whose splits `search(rows at open nodes, class totals of these nodes)` finds level by level."""
    if max_depth > MAX_LEVELS:
        raise ValueError(f"trees deeper than {MAX_LEVELS} levels do not fit into 64-bit node numbers")
    rows = materialize(rows, "training")  # read twice per level
    splits, counted = None, None
    for depth in range(max_depth + 1):
        placed = _at_nodes(rows, splits, keys, depth)
        level = materialize(class_counts(placed, keys), f"classes_{depth}")
        counted = level if counted is None else counted.unionByName(level)
        if depth == max_depth:
            break
        node = Window.partitionBy(*keys, "node")  # over the classes of a node
        sized = level.select("*", F.sum("n").over(node).alias("node_n"), F.count(F.lit(1)).over(node).alias("classes"))
        totals = sized.filter((F.col("classes") > 1) & (F.col("node_n") >= 2 * min_leaf)).select(*level.columns)
        searched = placed.join(totals.select(*keys, "node"), [*keys, "node"], "left_semi")
        found = materialize(search(searched, totals), f"splits_{depth}")
        splits = found if splits is None else splits.unionByName(found)
        if found.isEmpty():
            break
    return materialize(_node_table(counted, splits, keys), "nodes")


def _node_table(counted: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    classes = counted.filter(F.col("node") == 1).select(*keys, "label")
    nodes = counted.select(*keys, "node").distinct()
    full = nodes.join(classes, keys).join(counted, [*keys, "node", "label"], "left")
    count = F.coalesce("n", F.lit(0))
    entry = F.struct((-count).alias("o"), F.col("label"), count.alias("n"))
    dist = full.groupBy(*keys, "node").agg(
        F.sum("n").alias("n"),
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n"))
        ).alias("dist"),
    )
    return dist.join(splits, [*keys, "node"], "left").select(*keys, "node", "feature", "threshold", "n", "dist")


# --- prediction -------------------------------------------------------------------------------
def tree_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: `splits` map and `leaves` map (node -> class distribution)."""
    split = F.when(
        F.col("feature").isNotNull(), F.struct("node", F.struct("feature", "threshold").cast(NODE).alias("split"))
    )
    return nodes.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(split)).alias("splits"),
        F.map_from_entries(F.collect_list(F.struct("node", "dist"))).alias("dists"),
    )


def predict(
    cases: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    *,
    depth: int | Column | None = None,
    truth: str | None = "root_cause",
) -> DataFrame:
    """Add leaf, pred_rc, pred_scores, pred_top1_rc, cot, and with a truth column rank and is_correct.

    All classes of the training window are ranked by leaf share, ties by class name. The tree of a key is
    one small row, so this is one lookup join and row-wise work. Without `depth` rows walk to their leaf.
    """
    joined = cases.join(tree_rows(nodes, keys), list(keys))
    joined = joined.withColumn("leaf", node_of(F.col("splits"), F.col("features"), height_of(F.col("splits")) if depth is None else depth))
    joined = joined.withColumn("_dist", F.try_element_at("dists", "leaf"))
    total = F.aggregate("_dist", F.lit(0).cast("bigint"), lambda a, d: a + d["n"])
    predicted = (
        joined.withColumn("pred_rc", F.transform("_dist", lambda d: d["label"]))
        .withColumn("pred_scores", F.transform("_dist", lambda d: F.struct(d["label"].alias("root_cause"), (d["n"] / total).alias("score"))))
        .withColumn("pred_top1_rc", F.get("pred_rc", F.lit(0)))
    )
    class_id = F.array_position(F.array_sort("pred_rc"), F.col("pred_top1_rc")) - 1
    predicted = predicted.withColumn(
        "cot", F.create_map(path_text(F.col("splits"), F.col("leaf"), names), class_id.cast("int"))
    ).drop("splits", "dists", "_dist")
    if truth is None:
        return predicted
    labelled = F.col(truth).isNotNull() & (F.col(truth) != "")
    return predicted.withColumn("rank", F.when(labelled, truth_rank(F.col("pred_rc"), F.col(truth)))).withColumn(
        "is_correct", F.when(labelled, F.col("pred_top1_rc") == F.col(truth))
    )


def rules(nodes: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per leaf: path, predicted class and its id, rows, class distribution."""
    leaves = nodes.filter(F.col("feature").isNull()).join(tree_rows(nodes, keys).select(*keys, "splits"), list(keys))
    top = F.get("dist", F.lit(0))["label"]
    classes = F.array_sort(F.transform("dist", lambda d: d["label"]))
    return leaves.select(
        *keys,
        F.col("node").alias("leaf"),
        path_text(F.col("splits"), F.col("node"), names).alias("path"),
        top.alias("root_cause"),
        (F.array_position(classes, top) - 1).cast("int").alias("class_id"),
        "n",
        "dist",
    )


def rule_lines(nodes: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Printable tree per key, one row per line in reading order (`line` sorts)."""
    labels = F.array(*[F.lit(n) for n in names])
    level = level_of(F.col("node"))
    bits = F.bin("node")
    indent = F.repeat(F.lit("|   "), level)
    feature, shown = F.get(labels, F.col("feature")), F.format_string("%.2f", F.col("threshold"))
    classes = F.array_sort(F.transform("dist", lambda d: d["label"]))
    leaf = F.concat(indent, F.lit("|--- class: "), (F.array_position(classes, F.get("dist", F.lit(0))["label"]) - 1).cast("string"))
    lines = F.when(
        F.col("feature").isNotNull(),
        F.array(
            F.struct(F.concat(bits, F.lit("0")).alias("line"), F.concat(indent, F.lit("|--- "), feature, F.lit(" <= "), shown).alias("text")),
            F.struct(F.concat(bits, F.lit("1")).alias("line"), F.concat(indent, F.lit("|--- "), feature, F.lit(" >  "), shown).alias("text")),
        ),
    ).otherwise(F.array(F.struct(F.concat(bits, F.lit("~")).alias("line"), leaf.alias("text"))))
    return nodes.select(*keys, F.explode(lines).alias("l")).select(*keys, "l.line", "l.text")


def class_mapping(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    classes = F.array_sort(F.transform("dist", lambda d: d["label"]))
    return nodes.filter(F.col("node") == 1).select(*keys, F.posexplode(classes).alias("class_id", "root_cause"))


# --- depth by validation ----------------------------------------------------------------------
def depth_scores(cases: DataFrame, nodes: DataFrame, keys: Sequence[str], depths=vocab.DEPTH_CANDIDATES, truth="root_cause") -> DataFrame:
    """Accuracy of every candidate depth. The tree is grown once: a shallower tree is its upper part."""
    wanted = list(dict.fromkeys(int(d) for d in depths))
    if not wanted or min(wanted) <= 0:
        raise ValueError("depth candidates must be positive")
    joined = cases.join(tree_rows(nodes, keys), list(keys))
    leaves = joined.withColumns({f"_leaf_{d}": node_of(F.col("splits"), F.col("features"), d) for d in wanted})
    known = F.col(truth).isNotNull() & (F.col(truth) != "")

    def hit(d: int) -> Column:
        return F.when(known, F.get(F.try_element_at("dists", F.col(f"_leaf_{d}")), F.lit(0))["label"] == F.col(truth))

    # Counted side by side: a row is not repeated for every depth.
    counted = leaves.groupBy(*keys).agg(
        *[x for d in wanted for x in (F.count(hit(d)).alias(f"_n_{d}"), F.count_if(hit(d)).alias(f"_hits_{d}"))]
    )
    tried = F.array(
        *[
            F.struct(F.lit(d).alias("max_depth"), F.lit(i).alias("pos"), F.col(f"_n_{d}").alias("labeled_total"), F.col(f"_hits_{d}").alias("correct"))
            for i, d in enumerate(wanted)
        ]
    )
    return counted.select(*keys, F.explode(tried).alias("t")).select(
        *keys, "t.*", F.try_divide("t.correct", "t.labeled_total").alias("accuracy")
    )


def choose_depth(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best accuracy, first candidate on ties. The scored block is the inferred one, as the column says."""
    best = F.max_by(F.struct("max_depth", "accuracy"), F.struct(F.col("accuracy"), -F.col("pos")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(
        *keys,
        F.col("b.max_depth").alias("selected_max_depth"),
        F.col("b.accuracy").alias("selected_accuracy"),
        F.lit("infer_cases").alias("validation_source"),
    )


def run(
    train: DataFrame,
    infer: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    *,
    label: str = "root_cause",
    depths: Sequence[int] | None = None,
    max_depth: int = vocab.MAX_DEPTH,
    min_leaf: int = vocab.MIN_SAMPLES_LEAF,
) -> tuple[DataFrame, DataFrame]:
    """Train and predict all keys in one go: (predictions, nodes).

    With `depths` the depth of every key is chosen by accuracy on its inferred block.
    """
    keys = list(keys)
    grow = max(depths) if depths else max_depth
    nodes = fit(train.withColumn("label", F.col(label)), keys, max_depth=grow, min_leaf=min_leaf)
    if not depths:
        return predict(infer, nodes, keys, names, depth=grow, truth=label), nodes  # as deep as trees can be: to the leaf
    chosen = choose_depth(depth_scores(infer, nodes, keys, depths, label), keys)
    sized = infer.join(materialize(chosen, "depths"), keys)
    predicted = predict(sized, nodes, keys, names, depth=F.col("selected_max_depth"), truth=label)
    return predicted, nodes
