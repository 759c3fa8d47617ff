"""Hard negatives by angular filtering against brute force, and on awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import oracle
import pytest

import __spark_entry__ as entry
from caseflow.llm import hard_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, dims int"


def brute(rows, every=10, k=5):
    """In Python integers. Rows under one id: the smallest by label (as text) and vector."""
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (str(label), v)), (str(label), v))
    clip = lambda x: max(-hard_negatives.SATURATED, min(hard_negatives.SATURATED, math.floor(256 * x)))
    whole = {i: (label, [clip(x) for x in v]) for i, (label, v) in kept.items()}
    found = set()
    for a, (label, q) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other == label) for i, (other, v) in whole.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2]][:k]:
            fits = [(ns, n) for ns, n, same in scored if not same and -80 * ps <= -100 * ns <= -100 * ps]
            found |= {(a, p, rank, n, -ps, -ns) for rank, (ns, n) in enumerate(fits[:k], 1)}
    return found


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = [tuple(r[n] for n in names) for r in hard_negatives.mine(df, every=10, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


def clustered(seed, n, dims=12, spread=0.15, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    at = rng.integers(0, 6, n)
    body = (centres[at] + spread * rng.standard_normal((n, dims))) * rng.uniform(0.5, 2, (n, 1))
    return [(i, body[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("cells", [1 << 21, 150])
def test_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2048)
    rows = clustered(1, 400)
    expected = brute(rows)
    assert len(expected) > 300 and mined(spark, rows, anchor_cells=cells) == expected


def test_one_label_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1024)
    rows = [(i, v, 0 if i % 10 < 9 else label) for i, v, label in clustered(2, 300, spread=2.0)]
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_signs(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(60)] + [(i, [-1.0, -0.5], i % 3) for i in range(60, 90)] + [(i, [0.0, 0.0], i % 2) for i in range(90, 110)]
    expected = brute(rows)
    assert mined(spark, rows) == expected and {r[2] for r in expected} == {1, 2, 3, 4, 5}
    assert mined(spark, rows + rows[:15]) == expected


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = clustered(3, 60)
    rows += [(None, [1.0], 1), (60, None, 1), (61, [1.0, None], 1), (62, [float("nan")], 1), (63, [float("inf")], 1), (64, [1.0], None), (70, [], 1), (71, [], 2)]
    rows += [(80, [rng.random() for _ in range(5)], 1), (81, [rng.random() for _ in range(30)], 2), (90, [1e30, -1e30, 3.0], 1), (91, [1e9] * 4, 1), (92, [9e8] * 4, 2)]
    rows += [(10, [0.5] * 12, 0), (10, [0.5] * 12, 0), (0, [2.0] * 12, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == set() and mined(spark, [(60, None, 1)]) == set() and mined(spark, [(10, [0.0], 1), (11, [0.0], 1)]) == set()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(5)
    references = rng.standard_normal((7, 9))
    references /= np.sqrt((references**2).sum(1))[:, None]
    for size in (1, 300, 2**30):
        a, b = (np.floor(size * rng.standard_normal((80, 9))) for _ in range(2))
        b[:20], b[20:30] = a[:20] * 2, -a[:10]
        norms = [np.sqrt((x**2).sum(1)) for x in (a, b)]
        angles = [hard_negatives.angles_to(x, n, references) for x, n in zip((a, b), norms, strict=True)]
        low, high = hard_negatives.score_bounds(*hard_negatives.angle_bounds(angles[0], angles[1], angles[1]), norms[0], norms[1], norms[1])
        exact = a.astype(object) @ b.astype(object).T
        assert (low <= exact).all() and (exact <= high).all()


def test_windows_skip_rows():
    rows = clustered(6, 2000, spread=0.05)
    values = np.floor(256 * np.array([v for _, v, _ in rows]))
    norms = np.sqrt((values**2).sum(1))
    references = hard_negatives.kmeans(values / norms[:, None], 6)
    references /= np.sqrt((references**2).sum(1))[:, None]
    body = hard_negatives.Rows(np.arange(2000), values, norms, hard_negatives.angles_to(values, norms, references))
    anchors = hard_negatives.Rows(*(x[:40] for x in body))
    exact = hard_negatives.products(anchors.values, body.values)
    low = np.sort(exact, 1)[:, -20].astype(float)
    seen = np.zeros(exact.shape, bool)
    for own, row, scores in hard_negatives.windowed(anchors, body, low, np.full(40, np.inf)):
        assert (scores == exact[own, row]).all()
        seen[own, row] = True
    assert seen.mean() < 0.4 and (seen | (exact < low[:, None]) | (anchors.ids[:, None] == body.ids[None])).all()


def test_query_against_sql(spark):
    name = "op13_angular_hard_negatives"
    r = oracle.compare(spark, oracle.connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r["note"]
