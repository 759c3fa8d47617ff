import random

import pytest

from caseflow.operators import incremental as inc

CASES = "scenario string, idx bigint"


def test_new_cases_use_their_own_mode(spark):
    cases = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], CASES)
    marks = spark.createDataFrame([("a", "tree", "a", 4), ("a", "llm", "a", 0)], "folder string, mode string, alarm_type string, last_index bigint")
    rows = lambda df: sorted((r.scenario, r.idx, r.previous_last_index) for r in df.collect())
    assert rows(inc.select_new(cases, marks, "tree")) == [("a", 5, 4), ("b", 2, -1)]
    assert rows(inc.select_new(cases, marks, "llm")) == [("a", 1, 0), ("a", 5, 0), ("b", 2, -1)]
    assert len(rows(inc.select_new(cases, marks, "tree", reset=True))) == 3
    with pytest.raises(ValueError):
        inc.select_new(cases, marks, "tree", max_new=0)


def test_checkpoint_stops_below_first_failure(spark):
    rng = random.Random(7)
    outcomes, previous, expected = [], [], {}
    for s in range(40):
        idxs = sorted(rng.sample(range(100), rng.randint(0, 12)))
        oks = [rng.random() < 0.8 for _ in idxs]
        mark = -1
        for idx, ok in zip(idxs, oks):
            if not ok:
                break
            mark = idx
        previous.append((f"s{s}", -1))
        outcomes += [(f"s{s}", i, o) for i, o in zip(idxs, oks)]
        expected[f"s{s}"] = mark
    got = inc.advance(
        spark.createDataFrame(outcomes, "scenario string, idx bigint, ok boolean"),
        spark.createDataFrame(previous, "scenario string, previous_last_index bigint"),
    )
    assert {r.scenario: r.last_index for r in got.collect()} == expected


def test_stages_and_train_window(spark):
    cases = spark.createDataFrame([("a", i) for i in range(51, 251)] + [("a", 1), ("b", 3)], CASES)
    window = inc.select_window(cases, 51, 251)
    specs = {r.stage: r for r in inc.stage_specs(window, 50).collect()}
    assert sorted(specs) == [1, 2, 3]
    assert (specs[2].train_n, specs[2].train_last_idx, specs[2].infer_first_idx, specs[2].infer_last_idx) == (100, 150, 151, 200)
    members = inc.with_stages(window, 50).groupBy("stage", "part").count().collect()
    assert {(r.stage, r.part): r["count"] for r in members} == {(s, p): n for s in (1, 2, 3) for p, n in (("train", 50 * s), ("infer", 50))}
    train = inc.trailing_train_window(cases, inc.select_window(cases, 60, 70), 5)
    assert sorted(r.idx for r in train.collect()) == [55, 56, 57, 58, 59]
    short = inc.short_train_windows(train, cases.select("scenario", "idx"), 6).collect()
    assert {(r.scenario, r.available) for r in short} == {("a", 5), ("b", 0)}


def test_missing_indices(spark):
    cases = spark.createDataFrame([("a", i) for i in (51, 52, 55, 300)] + [("b", 1)], CASES)
    got = inc.missing_indices(cases, 51, 56, chunk=2).collect()
    assert sorted((r.scenario, r.idx) for r in got) == [("a", 53), ("a", 54), ("a", 56)] + [("b", i) for i in range(51, 57)]
