"""Binned trees against exact trees."""

import random

import pytest
from pyspark.sql import functions as F

from caseflow.operators import binned, tree

SCHEMA = "key string, features array<double>, label string"


def rows(n, seed, values):
    """Two keys; the class depends on two of three features, with noise."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        f = [float(rng.randrange(values)) for _ in range(3)]
        f[rng.randrange(3)] = None if rng.random() < 0.05 else f[0]
        score = (f[0] or 0) / values + (f[2] or 0) / (2 * values)
        label = rng.choice("abc") if rng.random() < 0.15 else "abc"[min(2, int(2 * score))]
        out.append(("hot" if i % 10 else "cold", f, label))
    return out


def table(nodes):
    return sorted((r.key, r.node, r.feature, r.threshold, r.n, str(r.dist)) for r in nodes.collect())


def gini_gain(nodes):
    """Share of the root's squares that the leaves reach: the higher, the purer."""
    leaves = [r for r in nodes.filter("feature IS NULL").collect()]
    squares = sum(sum(d.n**2 for d in r.dist) / r.n for r in leaves)
    return squares / sum(r.n for r in leaves)


def test_exact_where_every_value_has_a_bin(spark):
    train = spark.createDataFrame(rows(3000, 1, 20), SCHEMA).repartition(5)
    assert binned.bin_edges(train, ["key"], 32).filter("NOT exact").count() == 0
    assert table(binned.fit(train, ["key"], bins=32, max_depth=3)) == table(tree.fit(train, ["key"], max_depth=3))


def test_fewer_bins_cost_little_and_more_bins_cost_less(spark):
    train = spark.createDataFrame(rows(6000, 2, 5000), SCHEMA).repartition(5)
    exact = gini_gain(tree.fit(train, ["key"], max_depth=2))
    coarse, fine = (gini_gain(binned.fit(train, ["key"], bins=b, max_depth=2)) for b in (8, 128))
    assert coarse <= exact + 0.02 and exact - coarse < 0.06  # a greedy tree may gain on its second level
    assert abs(exact - fine) < 0.01


def test_bins_hold_near_equal_shares(spark):
    train = spark.range(20_000).select(F.lit("k").alias("key"), F.array((F.col("id") * 7919 % 20_000).cast("double")).alias("features"), F.lit("x").alias("label"))
    edges = binned.bin_edges(train, ["key"], 16)
    assert edges.first().exact is False and len(edges.first().edges) == 16
    sizes = [r["n"] for r in binned.with_bins(train, edges, ["key"], 16).groupBy("bins").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.1 * 20_000 / 16


def test_bin_of_matches_bisect(spark):
    import bisect

    edges = [1.0, 2.0, 2.5, 7.0, 9.0]
    values = [-3.0, 1.0, 1.5, 2.0, 2.2, 2.5, 6.9, 7.0, 8.0, 9.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(binned.bin_of(F.array(*[F.lit(e) for e in edges]), F.col("v"), 5)).collect()]
    assert found == [min(bisect.bisect_left(edges, v), 4) for v in values]


def test_thresholds_lie_between_values_of_the_node(spark):
    train = spark.createDataFrame(rows(2000, 3, 900), SCHEMA)
    nodes = binned.fit(train, ["key"], bins=8, max_depth=1)
    split = {r.key: (r.feature, r.threshold) for r in nodes.filter("feature IS NOT NULL").collect()}
    assert set(split) == {"hot", "cold"}
    for key, (feature, threshold) in split.items():
        values = sorted({v[feature] or 0.0 for k, v, _ in [(r.key, r.features, r.label) for r in train.collect()] if k == key})
        assert any(a < threshold < b and threshold == (a + b) / 2 for a, b in zip(values, values[1:]))


def test_small_and_empty_input(spark):
    few = spark.createDataFrame([("k", [1.0], "a"), ("k", [None], "b")], SCHEMA)
    assert [(r.node, r.n) for r in binned.fit(few, ["key"], max_depth=2).collect()] == [(1, 2)]
    assert binned.fit(few.limit(0), ["key"], max_depth=2).count() == 0
    with pytest.raises(ValueError):
        binned.fit(few, ["key"], bins=1)


def test_values_with_their_own_bin_are_looked_up(spark):
    """Values that are edges take no search; others still halve, and both give the same bins."""
    df = spark.createDataFrame([([1.0, 2.0, 2.5], v) for v in (1.0, 2.5, 1.5, -3.0, 9.0)], "e array<double>, v double")
    found = df.select(binned.bin_of(F.col("e"), F.col("v"), 4).alias("b"))
    assert [r.b for r in found.collect()] == [0, 2, 1, 0, 2]
    assert "array_position(" in found._jdf.queryExecution().executedPlan().toString()
