import pytest

from caseflow.operators import evaluate, repair

ROW = "method string, scenario string, case_idx bigint, groundtruth string, pred_rc array<string>, parse_strategy string"


def ranked(spark, rows):
    return evaluate.rank_predictions(spark.createDataFrame(rows, ROW))


def test_metric_arithmetic(spark):
    preds = ["x1", "x2", "A"]
    rows = [("m", "s", 1, "A", ["A"], "ok"), ("m", "s", 2, "A", preds, "ok"), ("m", "s", 3, "A", [], "unparsed"), ("m", "t", 4, "", ["A"], "ok")]
    runs = spark.createDataFrame([("m", "s", 3.0), ("m", "s", 6.0), ("m", "gone", 1.0)], "method string, scenario string, elapsed_seconds double")
    board = {r.scope: r for r in evaluate.leaderboard(ranked(spark, rows), runs).collect()}
    s = board["s"]
    assert (s.evaluated_count, s.unparsed_count) == (3, 1)
    assert [s.top1, s.top3, s.top5, s.mrr] == pytest.approx([1 / 3, 2 / 3, 2 / 3, 4 / 9])
    assert (s.elapsed_seconds, s.average_seconds_per_case) == (9.0, 3.0)
    assert (board["t"].evaluated_count, board["t"].top1, board["t"].average_seconds_per_case) == (0, None, None)
    assert board["overall"].elapsed_seconds == 10.0 and board["overall"].evaluated_count == 3


def test_halves_put_the_odd_row_last(spark):
    rows = [("m", "s", i, "A", ["A"] if i < 3 else ["B"], "ok") for i in range(5)]
    got = {(r.scope, r.half): (r.evaluated_count, r.top1) for r in evaluate.half_metrics(ranked(spark, rows)).collect()}
    assert got[("s", "first_100")] == (2, 1.0) and got[("s", "last_100")] == (3, pytest.approx(1 / 3))
    assert got[("overall", "last_100")] == got[("s", "last_100")]


def test_failed_selection_and_merge(spark):
    kind = "scenario string, alarm_type string, case_idx bigint, pred_rc array<string>, parse_strategy string, seq int"
    base = spark.createDataFrame(
        [("s", "s", 1, ["A"], "structured_array", 0), ("s", "s", 2, [], "unparsed", 0), ("s", "s", 3, ["A"], "x:candidate_text_fallback", 0), ("s", "s", 4, ["A"], "rerun_inference_failed", 0)],
        kind,
    )
    ids = lambda df: sorted(r.case_idx for r in df.collect())
    assert ids(repair.failed_cases(base)) == [2, 4]
    assert ids(repair.failed_cases(base, True)) == [2, 3, 4]
    new = spark.createDataFrame([("s", "s", 2, ["B"], "rerun:a", 1), ("s", "s", 2, ["C"], "rerun:b", 2), ("z", "z", 2, ["D"], "rerun:c", 3)], kind)
    merged = {r.case_idx: (r.pred_rc, r.rerun) for r in repair.merge_reruns(base, new).collect()}
    assert merged == {1: (["A"], False), 2: (["C"], True), 3: (["A"], False), 4: (["A"], False)}
    assert [r.indices for r in repair.rerun_plan(repair.failed_cases(base)).collect()] == [[2, 4]]
