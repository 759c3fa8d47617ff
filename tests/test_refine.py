"""Refining rounds: carried selections, fallbacks, stops, and what the prompts show."""

import json

import pytest
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators import features, refine, selection

GOOD = {"log": [vocab.EXCEPTION_TEMPLATES[0]], "kpi": {"traffic_in": ["mix", "max"]}}
OTHER = {"log": ["flash_count"], "kpi": {}}
TEMPLATE = "{alarm_type}#{round}#{previous_selection}#{validcase_summary}"


def cases(spark, low, high):
    """The class follows one log counter in scenario `a`; in `b` it is always the same."""
    body = f"""concat('{{"anomaly_logs":{{"local_exception":{{"{vocab.EXCEPTION_TEMPLATES[0]}":', id % 5, '}}}}}}')"""
    rows = spark.range(low, high).crossJoin(spark.createDataFrame([("a",), ("b",)], "scenario string"))
    return rows.select(
        "scenario", F.col("id").alias("idx"), F.parse_json(F.expr(body)).alias("sem"),
        F.when(F.col("scenario") == "b", "same").otherwise(F.when(F.col("id") % 5 > 2, "high").otherwise("low")).alias("root_cause"),
    )


def first(spark, chosen, names="ab"):
    start = selection.normalise(F.parse_json(F.lit(json.dumps(chosen))))
    return spark.createDataFrame([(n,) for n in names], "scenario string").select("scenario", start.alias("selection"))


def test_selections_are_carried_and_refined(spark):
    seen = []

    def ask(prompts):
        asked = {(r.scenario, r.round): r.prompt for r in prompts.collect()}
        seen.append(asked)
        rows = []
        for (scenario, number), _ in asked.items():
            if scenario == "a":
                rows.append((scenario, 1, "no json here"))
                rows.append((scenario, 2, f"```json\n{json.dumps(GOOD if number == 0 else OTHER)}\n```" if number < 2 else "{"))
        return spark.createDataFrame(rows, "scenario string, pos int, text string")

    found = refine.refine(cases(spark, 0, 200), cases(spark, 200, 260), first(spark, OTHER), ask, TEMPLATE, rounds=3)
    state = {(r.scenario, r.round): r for r in found.state.collect()}
    assert sorted(state) == [(s, n) for s in "ab" for n in range(3)]
    assert [state["a", n].selection.log for n in range(3)] == [["flash_count"], GOOD["log"], ["flash_count"]]
    assert state["a", 0].accuracy == 0.6 and state["a", 1].accuracy == 1.0 and state["b", 0].accuracy == 1.0
    assert [state["a", n].fallback_reason is None for n in range(3)] == [True, True, False]
    assert all(state["b", n].fallback_reason for n in range(3)) and not any(r.stopped for r in state.values())
    assert {r.scenario: r.selection.log for r in found.selections.collect()} == {"a": ["flash_count"], "b": ["flash_count"]}
    alarm, number, previous, summary = seen[1]["a", 1].split("#")
    assert (alarm, number) == ("a", "1") and json.loads(previous)["log"] == GOOD["log"]
    assert json.loads(summary)["accuracy"] == 1.0 and len(json.loads(summary)["correct_cases"]) == vocab.CORRECT_CASES
    assert len(json.loads(seen[0]["a", 0].split("#")[3])["wrong_cases"]) == vocab.WRONG_CASES
    assert found.prompts.count() == 6


def test_stopped_scenarios_are_not_asked_again(spark):
    asked = []

    def ask(prompts):
        asked.append(sorted(r.scenario for r in prompts.collect()))
        return prompts.select("scenario", F.lit(1).alias("pos"), F.lit(f"```json\n{json.dumps(GOOD)}\n```").alias("text"))

    found = refine.refine(cases(spark, 0, 200), cases(spark, 200, 260), first(spark, OTHER), ask, TEMPLATE, rounds=4, stop_at=0.99)
    assert asked == [["a"], []]  # b is right at once, a after its first answer
    assert sorted((r.scenario, r.round, r.stopped) for r in found.state.collect()) == [("a", 0, False), ("a", 1, True), ("b", 0, True)]
    assert {r.scenario: r.selection.log for r in found.selections.collect()} == {"a": GOOD["log"], "b": ["flash_count"]}


def test_scenarios_without_rows_have_no_summary(spark):
    ask = lambda prompts: prompts.select("scenario", F.lit(1).alias("pos"), "prompt").withColumnRenamed("prompt", "text").limit(0)
    found = refine.refine(cases(spark, 0, 60), cases(spark, 60, 80), first(spark, GOOD, "az"), ask, TEMPLATE)
    state = {r.scenario: r for r in found.state.collect()}
    assert state["z"].summary is None and state["z"].accuracy is None and state["a"].accuracy == 1.0
    assert {r.scenario: r.prompt.split("#")[3] for r in found.prompts.collect()}["z"] == "{}"
    with pytest.raises(ValueError):
        refine.refine(cases(spark, 0, 9), cases(spark, 0, 9), first(spark, GOOD), ask, TEMPLATE, rounds=0)


def test_documents_are_opened_once_for_all_rounds(spark, monkeypatch):
    calls, wide = [], []
    extract, materialize = features.extract_features, refine.materialize

    def stored(df, name):
        if name == "results":
            wide.append(df.columns)
        return materialize(df, name)

    monkeypatch.setattr(features, "extract_features", lambda *a, **b: (calls.append(1), extract(*a, **b))[1])
    monkeypatch.setattr(refine, "materialize", stored)

    def ask(prompts):
        return prompts.select("scenario", F.lit(1).alias("pos"), F.lit(json.dumps(GOOD)).alias("text"))

    found = refine.refine(cases(spark, 0, 200), cases(spark, 200, 260), first(spark, OTHER), ask, TEMPLATE, rounds=3)
    state = {(r.scenario, r.round): r for r in found.state.collect()}
    assert len(state) == 6 and state["a", 2].accuracy == 1.0
    assert len(calls) == 2 and wide == [["scenario", "case_idx", "is_correct"]] * 3
    shown = json.loads(state["a", 1].summary)["correct_cases"]
    assert len(shown) == vocab.CORRECT_CASES and all({"case_idx", "groundtruth", "pred_rc", "cot"} <= set(c) for c in shown)
    assert any(c.get("important_nonzero_features") for c in shown)
