import random
from collections import Counter

from pyspark.sql import functions as F

from caseflow.operators import tree

NAMES = ["f", "g", "h"]


def grow(rows, min_leaf, depth, node=1, out=None):
    """Exhaustive reference tree: every feature, every midpoint."""
    out = {} if out is None else out
    counts = Counter(label for _x, label in rows)
    out[node] = (None, None, dict(counts))
    if depth == 0 or len(counts) < 2 or len(rows) < 2 * min_leaf:
        return out
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _l in rows})
        for low, high in zip(values, values[1:]):
            left = Counter(l for x, l in rows if x[f] <= low)
            right = counts - left
            n, m = sum(left.values()), sum(right.values())
            if n < min_leaf or m < min_leaf:
                continue
            score = sum(c * c for c in left.values()) / n + sum(c * c for c in right.values()) / m
            if best is None or score > best[0] + 1e-9:
                best = (score, f, (low + high) / 2)
    if best is None:
        return out
    _s, f, threshold = best
    out[node] = (f, threshold, dict(counts))
    grow([r for r in rows if r[0][f] <= threshold], min_leaf, depth - 1, 2 * node, out)
    grow([r for r in rows if r[0][f] > threshold], min_leaf, depth - 1, 2 * node + 1, out)
    return out


def make(rng, n):
    rows = []
    for _ in range(n):
        x = [float(rng.randint(0, 6)), float(rng.randint(0, 30)), 0.0]
        rows.append((x, "a" if x[0] + rng.random() * 3 > 4 else rng.choice("bc") if x[1] > 10 else "b"))
    return rows


def test_trees_match_exhaustive_search(spark):
    rng = random.Random(5)
    groups = {"k1": make(rng, 150), "k2": make(rng, 60), "pure": [([1.0, 2.0, 0.0], "a")] * 30, "tiny": make(rng, 8)}
    df = spark.createDataFrame([(k, x, l) for k, rows in groups.items() for x, l in rows], "k string, features array<double>, label string")
    nodes = tree.fit(df, ["k"], max_depth=3, min_leaf=10)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.k, {})[r.node] = (r.feature, r.threshold, {d.label: d.n for d in r.dist if d.n})
    assert got == {k: grow(rows, 10, 3) for k, rows in groups.items()}
    paths = {(r.k, r.leaf): r.path for r in tree.rules(nodes, ["k"], NAMES).collect()}
    assert paths[("pure", 1)] == "(root leaf)"


def test_prediction_path_rank_and_depth(spark):
    rows = [([float(v), 0.0, 0.0], "a" if v <= 1 else ("b" if v == 2 else "c")) for v in (0, 1, 2, 3) for _ in range(10)]
    train = spark.createDataFrame([("k", x, l, l) for x, l in rows], "k string, features array<double>, label string, root_cause string")
    infer = spark.createDataFrame([("k", [2.0, 0.0, 0.0], "b"), ("k", [0.0, 0.0, 0.0], "z"), ("k", [3.0, 0.0, 0.0], "")], "k string, features array<double>, root_cause string")
    predicted, nodes = tree.run(train, infer, ["k"], NAMES, depths=(3, 2, 1))
    got = {r.root_cause: r for r in predicted.collect()}
    assert got["b"].pred_rc == ["b", "a", "c"] and got["b"].rank == 1 and got["b"].is_correct
    assert got["b"].cot == {"f > 1.50 -> f <= 2.50": 1}
    assert got["z"].rank is None and got["z"].is_correct is False
    assert got[""].rank is None and got[""].is_correct is None
    assert got["b"].selected_max_depth == 3  # all depths are equal here, the first one wins
    assert [r.text for r in tree.rule_lines(nodes, ["k"], NAMES).orderBy("line").collect()][:2] == ["|--- f <= 1.50", "|   |--- class: 0"]
    shallow = tree.predict(infer, nodes, ["k"], NAMES, depth=0)
    assert {r.leaf for r in shallow.collect()} == {1}


def test_missing_features_count_as_zero(spark):
    rows = [("k", [-5.0, 0.0], "a")] * 20 + [("k", [None, None], "b")] * 20
    df = spark.createDataFrame([(k, x, l, l) for k, x, l in rows], "k string, features array<double>, label string, root_cause string")
    predicted, nodes = tree.run(df, df, ["k"], ["f", "g"], max_depth=2, min_leaf=5)
    assert {(r.node, r.feature, r.threshold) for r in nodes.collect()} == {(1, 0, -2.5), (2, None, None), (3, None, None)}
    assert all(r.is_correct for r in predicted.collect()) and {r.leaf for r in predicted.collect()} == {2, 3}


def test_rows_walk_to_their_leaf_in_deep_trees(spark):
    import pytest

    levels = 40
    entries = [("k", 2**i, 0, float(levels - i), [("a", 1), ("b", 0)]) for i in range(levels)]
    entries += [("k", 2**levels, None, None, [("b", 9), ("a", 1)])] + [("k", 2 ** (i + 1) + 1, None, None, [("a", 2), ("b", 0)]) for i in range(levels)]
    nodes = spark.createDataFrame(entries, "k string, node bigint, feature int, threshold double, dist array<struct<label:string,n:bigint>>")
    cases = spark.createDataFrame([("k", [0.0], "b"), ("k", [4.5], "a")], "k string, features array<double>, root_cause string")
    got = {r.root_cause: r for r in tree.predict(cases, nodes, ["k"], ["f"]).collect()}
    assert got["b"].leaf == 2**levels and got["b"].is_correct and got["a"].leaf == 2 ** (levels - 3) + 1
    with pytest.raises(ValueError):
        tree.fit(cases.withColumnRenamed("root_cause", "label"), ["k"], max_depth=63)


def test_short_walks_are_compiled(spark):
    """A known number of steps is written out; it goes where the general walk goes, also past leaves and over nulls."""
    rows = spark.createDataFrame([([1.0, None],), ([2.5, 7.0],), ([9.0, -1.0],), ([],)], "features array<double>")
    entries = [(1, (0, 2.0)), (2, (1, 0.0)), (3, (1, 0.5)), (6, (0, 8.0))]
    table = spark.createDataFrame([(entries,)], "e array<struct<node bigint, split struct<feature int, threshold double>>>")
    cases = rows.crossJoin(table.select(F.map_from_entries("e").alias("splits")))
    walk = [tree.node_of(F.col("splits"), F.col("features"), d).alias(f"d{d}") for d in range(4)]
    general = [tree.node_of(F.col("splits"), F.col("features"), F.lit(d)).alias(f"g{d}") for d in range(4)]
    found = cases.select(*walk, *general).collect()
    assert [tuple(r)[:4] for r in found] == [tuple(r)[4:] for r in found] == [(1, 2, 4, 4), (1, 3, 7, 7), (1, 3, 6, 13), (1, 2, 4, 4)]
    assert "aggregate(" not in cases.select(*walk)._jdf.queryExecution().executedPlan().toString()


def test_depths_are_counted_without_repeating_rows(spark):
    rows = [("a", [float(i)], "x" if i < 20 else "y") for i in range(40)] + [("a", [1.0], ""), ("a", [1.0], None)]
    cases = spark.createDataFrame(rows, "k string, features array<double>, root_cause string")
    nodes = tree.fit(cases.filter("root_cause <> ''").withColumn("label", F.col("root_cause")), ["k"], max_depth=2, min_leaf=5)
    scores = tree.depth_scores(cases, nodes, ["k"], (2, 1, 2))
    assert sorted(tuple(r) for r in scores.collect()) == [("a", 1, 1, 40, 40, 1.0), ("a", 2, 0, 40, 40, 1.0)]
    before_counting = scores._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [k")[1]
    assert "Generate" not in before_counting
