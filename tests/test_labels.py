import json

import pytest

from caseflow.operators import backfill
from caseflow.sources import labels, tables
from caseflow.streaming.ingest import CASES, IncrementalSink, start, stream_labels


def write(root, scenario, name, doc):
    folder = root / scenario
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False), encoding="utf-8")


def test_discovery_resolution_and_loading(spark, tmp_path):
    write(tmp_path, "类 a+b", "类 a+b_7_label_S1.json", {"root_cause": {"category": "x"}, "root_cause_candidates": ["x", {"category": "y"}], "semantic_labels": {"sop": " ", "alarm_time": 5}, "sop": " top "})
    write(tmp_path, "类 a+b", "类 a+b_7_label_S0.json", {"root_cause": "first"})
    write(tmp_path, "类 a+b", "7_case_1.json", {})
    write(tmp_path, "类 a+b", "odd_8_label_1.json", {})
    write(tmp_path, "b", "label_3.json", {"semantic_labels": "odd", "alarm_time": 12, "root_cause": {"name": "n"}})
    write(tmp_path, "b", "9.txt", "no")
    files = labels.list_files(spark, str(tmp_path))
    assert sorted(r.scenario for r in labels.scenarios(files).collect()) == ["b", "类 a+b"]
    found = {(r.scenario, r.idx): r.label_path.rsplit("/", 1)[1] for r in labels.discover(files).collect()}
    assert found == {("类 a+b", 7): "类 a+b_7_label_S0.json", ("类 a+b", 8): "odd_8_label_1.json"}
    resolved = {(r.scenario, r.idx): (r.label_path.rsplit("/", 1)[1], r.case_path.rsplit("/", 1)[1]) for r in labels.resolve_paths(files).collect()}
    assert resolved == {("类 a+b", 7): ("类 a+b_7_label_S0.json", "7_case_1.json"), ("b", 3): ("label_3.json", "label_3.json")}
    cases = {r.idx: r for r in labels.load_cases(spark, str(tmp_path)).collect()}
    assert cases[7].root_cause == "first" and cases[7].candidates == ["first"] and cases[7].categories == []
    assert (cases[3].root_cause, cases[3].groundtruth, cases[3].alarm_time_ms, cases[3].sop) == ("n", "", 12.0, "")
    assert labels.load_cases(spark, str(tmp_path), scenario="b").count() == 1
    wanted = spark.createDataFrame([("类 a+b", 7), ("b", 99)], "scenario string, idx bigint")
    assert [r.idx for r in labels.load_cases(spark, str(tmp_path), wanted).collect()] == [7]


def test_bad_documents_go_to_quarantine(spark, tmp_path):
    write(tmp_path, "a", "a_1_label_x.json", "{broken")
    write(tmp_path, "a", "a_2_label_x.json", {})
    good, bad = labels.split_bad(labels.with_document(labels.read_documents(spark, str(tmp_path))))
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(ValueError):
        labels.require_none(bad, "unreadable")


def test_backfill_from_files(spark, tmp_path):
    target, source = tmp_path / "target", tmp_path / "source"
    write(target, "s", "s_1_label_A_B_1.json", {"note": 1})
    write(target, "s", "s_2_label_other.json", {"deep": [{"CsN": "C2"}]})
    write(target, "s", "s_3_label_C3.json", {})
    write(target, "s", "s_4_label_C4.json", {"root_cause": {"category": "kept"}})
    write(target, "s", "s_5_label_C9.json", {})
    write(source, "s", "x_9_label_A_B_1.json", {"csn": "A_B_1", "root_cause": {"description": "d", "category": "c1"}})
    write(source, "t", "sub_1_LABEL_C3.json", {"root_cause": {"category": "one"}})
    write(source, "u", "sub_1_label_C3.json", {"root_cause": {"category": "two"}})
    write(source, "u", "sub_2_label_C4.json", {"root_cause": {"category": " "}})
    read = lambda root: backfill.label_columns(labels.with_document(labels.label_files(labels.read_documents(spark, str(root), recursive=True))))
    usable, issues = backfill.source_index(read(source))
    assert [r.issue for r in issues.collect()] == ["source_missing_root_cause_category"]
    done = {r.path.rsplit("/", 1)[1][:3]: (r.outcome, r.root_cause) for r in backfill.fill(read(target), usable, apply=True).collect()}
    assert done == {
        "s_1": ("updated", '{"category":"c1","description":"d"}'), "s_2": ("invalid", None), "s_3": ("conflict", None),
        "s_4": ("already_present", '{"category":"kept"}'), "s_5": ("unmatched", None),
    }
    with pytest.raises(ValueError):
        backfill.gate(backfill.fill(read(target), usable), issues)
    backfill.gate(backfill.fill(read(target), usable), issues, allow_unresolved=True)


def test_response_trees(spark, tmp_path):
    for path, text in {"5/round0/meta": "a", "5/round1/meta": "b", "5/round1/reasoner": "c"}.items():
        (tmp_path / "coop" / path).mkdir(parents=True)
        (tmp_path / "coop" / path / "raw_responses.txt").write_text(text)
    for name, text in {"s t_analysis_Meta_5": "m", "s t_analysis_Reasoner_5": "v"}.items():
        (tmp_path / "comp" / name).mkdir(parents=True)
        (tmp_path / "comp" / name / "raw_responses.txt").write_text(text)
    coop = tables.read_response_tree(spark, str(tmp_path / "coop"), "cooperation").collect()
    assert {(r.case_idx, r.role, r.round, r.text) for r in coop} == {(5, "meta", 0, "a"), (5, "meta", 1, "b"), (5, "reasoner", 1, "c")}
    comp = tables.read_response_tree(spark, str(tmp_path / "comp"), "competition").collect()
    assert {(r.scenario, r.case_idx, r.role, r.text) for r in comp} == {("s t", 5, "competition", "m"), ("s t", 5, "verifier", "v")}


def test_stream_holds_the_checkpoint_at_a_failure(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    for i in (1, 2, 4):
        write(root, "a", f"a_{i}_label_x.json", {"ok": i != 2})
    write(root, "b", "b_9_label_x.json", {"ok": True})
    broken = {2}

    def process(selected):
        return selected.select("scenario", "idx", (~selected["idx"].isin(*broken) if broken else selected["idx"].isNotNull()).alias("ok"))

    sink = IncrementalSink(str(state), "tree_infer", process, CASES)
    start(stream_labels(spark, str(root)), sink).awaitTermination()
    marks = lambda: {r.folder: r.last_index for r in sink.checkpoints(spark).collect()}
    assert marks() == {"a": 1, "b": 9}
    broken.clear()
    write(root, "a", "a_7_label_x.json", {})
    write(root, "b", "b_3_label_x.json", {})  # late: below the checkpoint
    start(stream_labels(spark, str(root)), sink).awaitTermination()
    assert marks() == {"a": 7, "b": 9}
    got = {(r.scenario, r.idx): r.ok for r in sink.results(spark).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 4): True, ("a", 7): True, ("b", 9): True}


def test_stream_over_names_listed_by_tasks(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    for i in (1, 2):
        write(root, "a b+c", f"a b+c_{i}_label_%41.json", {"n": i})
    write(root, "a b+c", "a b+c_3_case_x.json", {})
    sink = IncrementalSink(str(state), "tree_infer", lambda s: s.select("scenario", "idx", s["doc"].isNotNull().alias("ok")), f"{CASES}, path string, doc variant")

    def advance():
        arrivals = stream_labels(spark, str(root), f"{state}/names")
        query = start(arrivals, sink)
        query.awaitTermination()
        return query.recentProgress

    seen = sum(p["numInputRows"] for p in advance())
    write(root, "b", "b_5_label_x.json", "{broken")
    write(root, "a b+c", "a b+c_7_label_x.json", {})
    more = advance()
    # The second start reads two new names; its source holds parts of names, not label files.
    assert sum(p["numInputRows"] for p in more) > 0 and seen > 0 and "names" in more[0]["sources"][0]["description"]
    assert sum(p["numInputRows"] for p in advance()) == 0
    assert sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{state}/names").collect()) == [
        "a b+c_1_label_%41.json", "a b+c_2_label_%41.json", "a b+c_7_label_x.json", "b_5_label_x.json"
    ]
    assert {(r.scenario, r.idx): r.ok for r in sink.results(spark).collect()} == {("a b+c", 1): True, ("a b+c", 2): True, ("a b+c", 7): True, ("b", 5): False}
    assert {r.folder: r.last_index for r in sink.checkpoints(spark).collect()} == {"a b+c": 7}
