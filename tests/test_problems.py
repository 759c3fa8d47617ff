"""Rows that cannot be numbered are set apart with a reason, and none is lost."""

from caseflow.operators import repair
from caseflow.operators.problems import check_cases, problem_counts

FORM = "scenario string, idx bigint, path string"


def test_every_row_is_accepted_or_a_problem(spark):
    rows = [("a", 1, "p2"), ("a", 1, "p1"), ("a", 2, "p"), ("a", None, "x"), (None, 5, "y"), (None, None, "z"), ("b", 1, "p"), ("b", None, None)]
    checked = check_cases(spark.createDataFrame(rows, FORM), first=["path"])
    assert sorted((r.scenario, r.idx, r.path) for r in checked.accepted.collect()) == [("a", 1, "p1"), ("a", 2, "p"), ("b", 1, "p")]
    got = {(r.scenario, r.idx, r.path): r.reason for r in checked.problems.collect()}
    assert got == {
        ("a", 1, "p2"): "repeated_index", ("a", None, "x"): "no_index", (None, 5, "y"): "no_group", (None, None, "z"): "no_index", ("b", None, None): "no_index",
    }
    counts = {(r.scenario, r.reason): r.n for r in problem_counts(checked.problems).collect()}
    assert counts[("a", "no_index")] == 1 and sum(counts.values()) + 3 == len(rows)
    empty = check_cases(spark.createDataFrame([], FORM))
    assert empty.accepted.count() == 0 and empty.problems.count() == 0


def test_reruns_are_complete(spark):
    form = "scenario string, alarm_type string, case_idx bigint"
    rows = [("s", None, i % 40) for i in range(50)] + [(None, "t", 3), (None, None, 4), ("s", None, None), (None, "t", None)]
    plan, bad = repair.checked_reruns(spark.createDataFrame(rows, form), 16)
    batches = {(r.scenario, r.batch): r.indices for r in plan.collect()}
    assert sorted(i for (s, _), b in batches.items() if s == "s" for i in b) == list(range(40)) and max(map(len, batches.values())) == 16
    assert batches[("t", 0)] == [3]
    assert sum(map(len, batches.values())) + bad.count() == len(rows)
    assert {r.reason for r in bad.collect()} == {"no_index", "no_group", "repeated_index"}
