import json

from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators import prompts, rounds, selection


def test_logs_shrink_first_then_the_whole_prompt(spark):
    long = '{"x":"' + "ab\\\"" * 200 + '"}'
    df = spark.createDataFrame([(1, "H" * 20, long, "T" * 20), (2, "H" * 400, "{}", "T" * 400), (3, "a", "{}", "b")], "i int, before string, logs_json string, after string")
    got = {r.i: r for r in prompts.fit_prompts(df, 320).collect()}
    one = got[1]
    assert (one.truncated, one.truncation_strategy) == (True, "anomaly_logs") and 315 <= one.final_tokens <= 320
    body = json.loads(one.prompt[20:-20])
    assert body["__truncated__"] and body["__original_token_count__"] == len(long)
    assert long.startswith(body["__head__"]) and long.endswith(body["__tail__"])
    assert one.retained_log_tokens == len(body["__head__"]) + len(body["__tail__"])
    two = got[2]
    assert two.truncation_strategy == "whole_prompt_fallback" and two.final_tokens == 320
    assert vocab.PROMPT_CUT_MARK in two.prompt and two.prompt.startswith("HHH") and two.prompt.endswith("TTT")
    assert (got[3].prompt, got[3].truncation_strategy) == ("a{}b", "none")


def test_the_largest_log_block_shrinks_first(spark):
    form = "i int, parts array<struct<text:string,is_log:boolean>>"
    note = '{"__truncated__":true}' + "c" * 300
    rows = [
        (1, [("A", False), ("x" * 400, True), ("B", False), ("q" * 900, True), ("C", False)]),  # the second block alone is enough
        (2, [("A", False), ("x" * 900, True), ("B", False), ("q" * 800, True), ("C", False)]),  # both
        (3, [("A" * 600, False), ("x" * 900, True), ("q" * 20, True)]),  # not even both
        (4, [("A", False), ("x" * 450, True), ("B", False), ("q" * 450, True)]),  # of equal ones the later
        (5, [("A" * 400, False), (note, True), ("q" * 400, True), (None, True)]),  # cut already, empty, null
        (6, [("A", False), ("x", True)]),
        (7, []),
    ]
    got = {r.i: r for r in prompts.fit_parts(spark.createDataFrame(rows, form), 620).collect()}
    assert (got[1].truncated_sections, got[1].truncation_strategy) == (1, "anomaly_logs") and "x" * 400 in got[1].prompt and 615 <= got[1].final_tokens <= 620
    assert got[2].truncated_sections == 2 and 615 <= got[2].final_tokens <= 620
    first = json.loads(got[2].prompt[1 : got[2].prompt.index("B{")])
    assert first["__original_token_count__"] == 900 and first["__head__"] == first["__tail__"] == ""
    assert got[2].retained_log_tokens == got[2].prompt.count("q")
    assert (got[3].truncation_strategy, got[3].truncated_sections, got[3].final_tokens, got[3].retained_log_tokens) == ("whole_prompt_fallback", 2, 620, 0)
    assert "x" * 450 in got[4].prompt and got[4].retained_log_tokens == got[4].prompt.count("q")
    assert note in got[5].prompt or got[5].truncation_strategy == "whole_prompt_fallback"
    assert (got[6].prompt, got[6].truncated_sections, got[7].prompt) == ("Ax", 0, "")


def test_logs_of_an_example_shrink_too(spark):
    docs = cases(spark).filter("case_idx < 3")
    example = F.array(prompts.part(F.lit('{"anomaly_logs":')), prompts.part(F.lit('"' + "e" * 900 + '"'), True), prompts.part(F.lit("}")))
    examples = spark.createDataFrame([("s",)], "scenario string").select("scenario", example.alias("parts"))
    template = "{alarm_type}|{semantic_labels}"
    free = {r.case_idx: r.prompt for r in prompts.build_prompts(docs, "reasoner", template, examples=examples).collect()}
    assert free[1] == 's|{"anomaly_logs":{"a":1},"k":{"z":2}}' + vocab.EXAMPLE_LEAD + '{"anomaly_logs":"' + "e" * 900 + '"}'
    cut = {r.case_idx: r for r in prompts.build_prompts(docs, "reasoner", template, examples=examples, budget=400).collect()}
    assert cut[1].truncation_strategy == "anomaly_logs" and 395 <= cut[1].final_tokens <= 400
    assert '{"a":1}' in cut[1].prompt and json.loads(cut[1].prompt.split(vocab.EXAMPLE_LEAD)[1])["anomaly_logs"]["__truncated__"]
    assert cut[2].prompt == free[2] and not cut[2].truncated


def cases(spark):
    docs = [("s", 1, '{"anomaly_logs":{"a":1},"k":{"z":2}}'), (vocab.NO_LOGS_SCENARIO, 2, '{"anomaly_logs":{"a":1}}'), ("t", 3, "{}")]
    df = spark.createDataFrame(docs, "scenario string, case_idx bigint, j string")
    return df.select("scenario", "case_idx", F.lit("do {x}").alias("sop"), F.array(F.lit("A")).alias("candidates"), F.parse_json("j").alias("sem"))


def test_assembly(spark):
    examples = spark.createDataFrame([("s", "EX")], "scenario string, text string")
    built = prompts.build_prompts(cases(spark), "reasoner", "{{T}} {alarm_type}|{semantic_labels}|{sop}|{root_cause_candidates}", examples=examples)
    got = {r.case_idx: r.prompt for r in built.collect()}
    assert got == {
        1: '{T} s|{"anomaly_logs":{"a":1},"k":{"z":2}}|do {x}|["A"]示例：EX',
        2: "{T} " + vocab.NO_LOGS_SCENARIO + '|{"anomaly_logs":{}}|do {x}|["A"]',
        3: '{T} t|{}|do {x}|["A"]',
    }


def test_model_calls_keep_partial_batches(spark):
    ask = spark.createDataFrame([("s", i, f"p{i}") for i in range(7)], "scenario string, case_idx bigint, prompt string").coalesce(1)

    def model(batch, sampler):
        if "p0" in batch:
            return [b + sampler["sample"] for b in batch][:2]
        raise RuntimeError("model is gone")

    got = {(r.case_idx, r.sample): r.text for r in rounds.invoke(ask, model, samplers=vocab.SAMPLERS, batch_size=4).collect()}
    assert len(got) == 21 and got[(0, "Reasoner2")] == "p0Reasoner2" and got[(1, "Reasoner1")] == "p1Reasoner1"
    assert [got[(i, "Reasoner3")] for i in range(2, 7)] == [None] * 5


def test_flows(spark):
    table = cases(spark)

    def competing(batch, sampler):
        return [f"{sampler['sample']}:{p}" if not p.startswith("V 2") else None for p in batch]

    said, stages = rounds.competition(table, competing, "R {case_idx}", "V {case_idx} {reasoner_outputs}")
    assert {r.case_idx: (r.stage, r.status) for r in stages.collect()} == {1: ("verified", "processed"), 2: ("sampled", "skipped"), 3: ("verified", "processed")}
    verdict = said.filter("role = 'verifier' and case_idx = 1").first().text
    assert verdict.startswith("single:V 1 === Reasoner1 ===\nReasoner1:R 1\n\n=====") and verdict.count("=== Reasoner") == 3

    stop = vocab.STOP_MARKER

    def cooperating(batch, sampler):
        out = []
        for p in batch:
            kind, case, rest = p.split(" ", 2)
            out.append(stop if kind == "M" and case == "1" and "[Last Reasoner]" in rest else None if case == "2" and kind == "R" else f"{kind}-{case}")
        return out

    said, state = rounds.cooperation(table, cooperating, "M {case_idx} {last_round_outputs}", "R {case_idx} {meta_output}", max_rounds=3)
    got = {r.case_idx: (r.rounds, r.stop_round, r.failed, r.status) for r in state.collect()}
    assert got == {1: (1, 1, False, "processed"), 2: (0, None, True, "skipped"), 3: (3, None, False, "processed")}
    assert said.filter("case_idx = 2").count() == 2


def test_selection_shapes(spark):
    texts = [
        ('<think> {"log": 1 }</think> ```json {"log": ["b", "a", "b"], "kpi": {"traffic_in": ["max", "max"]}} ```', ["b", "a"], ["max", "mix"]),
        ('[{"json": {"log": "x", "kpi": {"traffic_in": "alarming"}}}]', None, None),
        ('```json [{"cot": 1}, [{"json": {"log": "x", "kpi": {"traffic_in": "alarming"}}}]] ```', ["x"], ["alarming", "mean"]),
        ('```json {"log": {}, "kpi": 3} ```', ["template_occur_count"], ["mix", "mean"]),
    ]
    df = spark.createDataFrame([(f"s{i}", 0, t) for i, (t, _l, _k) in enumerate(texts)], "scenario string, pos int, text string")
    got = {r.scenario: r.selection for r in selection.selections_from_answers(df).collect()}
    for i, (_t, log, kpi) in enumerate(texts):
        s = got[f"s{i}"]
        if i == 1:  # the braces of a bare list still give the inner object
            assert s.log == ["x"]
            continue
        assert (s.log, s.kpi["traffic_in"]) == (log, kpi)
        assert s.kpi["temperature"] == ["mix", "mean"]


def test_feedback_is_bounded(spark):
    rows = [("s", 1, i, i % 3 == 0, {f"f{j}": float(j % 40) for j in range(100)}) for i in range(30)]
    df = spark.createDataFrame(rows, "scenario string, stage int, case_idx bigint, is_correct boolean, features map<string,double>")
    row = selection.feedback_summary(df).first()
    summary = json.loads(row.summary)
    assert [c["case_idx"] for c in summary["wrong_cases"]] == [1, 2, 4, 5, 7, 8, 10, 11]
    assert [c["case_idx"] for c in summary["correct_cases"]] == [0, 3]
    top = summary["wrong_cases"][0]["important_nonzero_features"]
    assert len(top) == 20 and top[0] == {"name": "f39", "value": 39.0} and top[1]["name"] == "f79"


def test_selection_in_any_number_of_lists(spark):
    want = '{"log":["x"],"kpi":{}}'
    rows = [(n, "[" * n + want + "]" * n) for n in range(9)] + [(20, "[1,[[]],[[" + want + "]]]"), (21, "[[[1]]]"), (22, '["[[' + want.replace('"', '\\"') + ']]"]')]
    df = spark.createDataFrame(rows, "n int, body string").select("n", selection.first_selection(F.try_parse_json("body")).alias("s"))
    got = {r.n: r.j for r in df.select("n", F.to_json("s").alias("j")).collect()}
    assert all(got[n] is not None and '"log":["x"]' in got[n] for n in [*range(9), 20, 22]) and got[21] is None


def test_prompts_are_cut_only_for_a_stated_budget(spark):
    df = spark.createDataFrame([("p" * 20_000, "l" * 9_000, "s")], "before string, logs_json string, after string")
    free = prompts.fit_prompts(df, None).first()
    assert len(free.prompt) == 29_001 and not free.truncated and free.final_tokens == free.original_tokens
    assert prompts.fit_prompts(df, 21_000).first().truncated


def test_stored_evidence_gives_the_same_prompts(spark):
    sem = F.parse_json(F.lit('{"anomaly_logs":{"a":1},"z":[1],"b":{"c":"d"}}'))
    cases = spark.createDataFrame([("s", 1), (vocab.NO_LOGS_SCENARIO, 2), ("e", 3)], "scenario string, case_idx bigint").withColumn(
        "sem", F.when(F.col("case_idx") < 3, sem).otherwise(F.parse_json(F.lit("{}")))
    )
    template = "{alarm_type}: {semantic_labels} of {case_idx}"
    want = {r.case_idx: r.prompt for r in prompts.build_prompts(cases, "x", template).collect()}
    stored = prompts.with_evidence(cases).drop("sem")
    assert {r.case_idx: r.prompt for r in prompts.build_prompts(stored, "x", template).collect()} == want
    assert want[1] == 's: {"anomaly_logs":{"a":1},"b":{"c":"d"},"z":[1]} of 1' and want[3] == "e: {} of 3"
    plain = {r.case_idx: r.prompt for r in prompts.build_prompts(stored, "x", template, drop_logs_for=None).collect()}
    assert '"anomaly_logs":{"a":1}' in plain[2] and '"anomaly_logs":{}' in want[2]
