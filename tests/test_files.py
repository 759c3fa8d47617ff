"""Files with names, file filters, checkpoint versions, and outputs that a rerun replaces."""

import json
import os
import threading

import oracle
import pytest
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.plans import files as plans
from caseflow.sources import files, labels, tables
from caseflow.sources import store as store_module
from caseflow.sources.files import delete_tree, in_ranges, index_ranges, write_named_files
from caseflow.sources.store import CheckpointStore, ConflictError, publish_file, replace_rows

WANTED = "scenario string, idx bigint"
MARKS = "folder string, mode string, alarm_type string, last_index bigint, updated_at timestamp"


def opened(df) -> int:
    """Files that the text scans of an executed plan opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "text" in node.relation().fileFormat().getClass().getName().lower():
            found += node.metrics().apply("numFiles").value()
        children = [node.child()] if node.getClass().getSimpleName().endswith("QueryStageExec") and hasattr(node, "child") else []
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())] + children
    return found


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    rows = spark.sql("SELECT id, IF(id % 2 = 0, 'a b+c', '类') AS s FROM range(400)").selectExpr(
        "concat(s, '/', s, '_', id, '_label_S', id, '.json') AS path", "concat('{\"root_cause\":\n\"c', id, '\"}') AS body"
    )
    written = write_named_files(rows, folder).collect()
    assert len(written) == 400 and all(r["bytes"] > 15 for r in written)
    return folder


def test_only_selected_files_are_opened(spark, root):
    wanted = spark.createDataFrame([("a b+c", i) for i in range(100, 160, 2)] + [("类", 7), ("类", 399), ("none", 3)], WANTED)
    cases = {(r.scenario, r.idx): r.root_cause for r in labels.load_cases(spark, root, wanted).collect()}
    assert cases == {("a b+c", i): f"c{i}" for i in range(100, 160, 2)} | {("类", 7): "c7", ("类", 399): "c399"}
    ranges = index_ranges(wanted)
    only = lambda s, name: in_ranges(ranges, s, labels.match_names(name, s, vocab.LABEL_NAMES)["idx"])
    assert opened(labels.read_documents(spark, root, only=only)) == 32
    assert opened(labels.read_documents(spark, root)) == 400
    assert labels.load_cases(spark, root, wanted.limit(0)).count() == 0


def test_tasks_list_and_open_the_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('a/a_', id, '_label_%41', id, '.json') AS path", "concat('{\"root_cause\":\"c', id, '\"}') AS body")
    extra = spark.createDataFrame([("a/deep/b_7_label_x.json", "{}"), ("a/.hidden_label_1.json", "{}"), ("a/_9_label_1.json", "{}"), ("a/e_5_label_.json", "")], rows.schema)
    write_named_files(rows.unionByName(extra), str(tmp_path)).collect()
    names = labels.list_files(spark, str(tmp_path))
    assert names.count() == 2000 and labels.list_files(spark, str(tmp_path), recursive=True).count() == 2001
    assert "binaryFile" not in names._jdf.queryExecution().executedPlan().toString()
    wanted = spark.createDataFrame([("a", 3), ("a", 1999), ("a", 5000)], WANTED)
    cases = labels.load_cases(spark, str(tmp_path), wanted)
    assert {r.idx: (r.root_cause, r.label_path) for r in cases.collect()} == {i: (f"c{i}", f"file:{tmp_path}/a/a_{i}_label_%41{i}.json") for i in (3, 1999)}
    read = labels.read_label_documents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and read.count() == 2001
    with pytest.raises(Exception, match="No such file"):
        labels.list_files(spark, f"{tmp_path}/none")


def test_roots_that_only_spark_reaches(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.labels.link./in", f"file://{tmp_path}")
    write_named_files(spark.createDataFrame([("s/s_1_label_x.json", "{}")], "path string, body string"), str(tmp_path)).collect()
    assert [r.idx for r in labels.load_cases(spark, "viewfs://labels/in").collect()] == [1]


def test_whole_texts_keep_their_lines(spark, root):
    assert {r.body.count("\n") for r in labels.read_documents(spark, root, scenario="类").collect()} == {1}


def test_ranges_grow_where_there_are_too_many(spark):
    wanted = spark.createDataFrame([("s", i) for i in range(0, 6000, 3)] + [("t", 5), ("t", 6), (None, 1), ("t", None)], WANTED)
    exact = index_ranges(wanted, 5000)
    assert len(exact) == 2001 and ("t", 5, 6) in exact and ("s", 3, 3) in exact
    assert index_ranges(wanted, 10) == [(s, lo, hi) for s, lo, hi in index_ranges(wanted, 10)] and len(index_ranges(wanted, 10)) == 7
    assert index_ranges(wanted, 2) == [("s", 0, 5997), ("t", 5, 6)]
    assert index_ranges(wanted, 1) is None and index_ranges(wanted.limit(0)) == []
    df = spark.createDataFrame([("s", 3), ("s", 4), ("t", 6), ("u", 3), (None, 3), ("s", None)], WANTED)
    assert [r[0] for r in df.select(in_ranges(exact, F.col("scenario"), F.col("idx"))).collect()] == [True, False, True, False, False, False]


def test_named_files_are_replaced_whole(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.json", "é\n"), ("2.json", ""), (None, "a"), ("3.json", None)], "path string, body string")
    for _ in range(2):
        assert sorted((r["path"], r["bytes"]) for r in write_named_files(rows, f"file://{tmp_path}").collect()) == [("2.json", 0), ("x/1.json", 3)]
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["1.json", "2.json"]
    assert (tmp_path / "x" / "1.json").read_text(encoding="utf-8") == "é\n"


def marks(spark, *rows):
    return spark.createDataFrame([(f, "tree", f, n, None) for f, n in rows], MARKS).withColumn("updated_at", F.timestamp_seconds("last_index"))


def test_versions_and_conflicts(spark, tmp_path):
    store = CheckpointStore(spark, f"{tmp_path}/store")
    assert store.versions() == [0] and store.read().count() == 0
    assert store.commit(marks(spark, ("a", 1), ("b", 2)), 0) == 1
    one, two = CheckpointStore(spark, f"{tmp_path}/store"), CheckpointStore(spark, f"{tmp_path}/store")
    based_on = one.latest()
    assert one.commit(marks(spark, ("a", 5)), based_on) == 2
    with pytest.raises(ConflictError):
        two.commit(marks(spark, ("a", 9)), based_on)
    table = lambda version=None: {(r.folder, r.last_index) for r in store.read(version).collect()}
    assert table() == {("a", 5), ("b", 2)} and table(1) == {("a", 1), ("b", 2)} and table(0) == set()
    with pytest.raises(ValueError):
        store.read(7)
    # A change that meets a conflict is computed again on what the other writer left.
    seen = []

    def change(rows):
        seen.append({(r.folder, r.last_index) for r in rows.collect()})
        if len(seen) == 1:
            one.commit(marks(spark, ("b", 8)), one.latest())
        return marks(spark, ("c", 3))

    assert two.update(change) == 4 and len(seen) == 2 and ("b", 8) in seen[1]
    assert table() == {("a", 5), ("b", 8), ("c", 3)}


def test_one_of_many_writers_publishes(spark, tmp_path):
    won = []
    writers = [threading.Thread(target=lambda i=i: publish_file(spark, f"{tmp_path}/m/1", f"w{i}") and won.append(i)) for i in range(12)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and (tmp_path / "m" / "1").read_text() == f"w{won[0]}" and len(list((tmp_path / "m").iterdir())) == 1


def test_publishing_through_hadoop_does_not_overwrite(spark, tmp_path):
    path = "viewfs://store/m/1"
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./m", f"file://{tmp_path}")
    assert publish_file(spark, path, "first") and not publish_file(spark, path, "second")
    assert (tmp_path / "1").read_text() == "first"


def test_replaced_rows(spark, tmp_path):
    form = "role string, scenario string, round int, case_idx bigint, sample string, text string"
    out = f"{tmp_path}/answers"
    first = [("meta", "s", 0, i, "", f"a{i}") for i in range(20)] + [("meta", None, 1, 1, None, "x"), ("reasoner", "s", 0, 1, "", "r")]
    again = [("meta", "s", 0, 3, "", "new"), ("meta", None, 1, 1, None, "y"), ("meta", "t", 0, 1, "", "t")]
    for _ in range(2):
        tables.write_responses(spark.createDataFrame(first, form), out)
    tables.write_responses(spark.createDataFrame(again, form), out)
    expected = {r[:5]: r[5] for r in first} | {r[:5]: r[5] for r in again}
    stored = spark.read.parquet(out).select("role", "scenario", "round", "case_idx", "sample", "text").collect()
    assert len(stored) == len(expected) and {tuple(r)[:5]: r.text for r in stored} == expected
    with pytest.raises(ValueError):
        replace_rows(spark.createDataFrame(first, form), out, ["text"], ["role"])


def test_metrics_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([("tree", 'o"v\\', 0.5)], "method string, scope string, top1 double")
    for _ in range(2):
        tables.write_metrics(df, str(tmp_path))
    lines = [json.loads(x) for p in (tmp_path / "metrics_json").glob("part*") for x in p.read_text().splitlines()]
    assert lines == [{"method": "tree", "scope": 'o"v\\', "top1": 0.5}]
    assert [r.asDict() for r in spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/metrics_csv").collect()] == [{"method": "tree", "scope": 'o"v\\', "top1": "0.5"}]


def test_response_text(spark):
    row = spark.sql("SELECT 'body' AS t").select(tables.response_text(F.col("t"), F.lit("Meta"))).first()[0]
    assert row == f"=== Response Meta ===\nbody\n\n{vocab.RULE}\n\n"


def test_all_formats_are_written_from_one_copy(spark, tmp_path, monkeypatch):
    """No further copy beside the Parquet files; folder names that look like numbers or dates stay text in the other formats."""
    monkeypatch.setattr(tables, "materialize", None)
    scenarios = ["007", "1.50", "2024-01-01", "a/b", "", None, "true"]
    rows = [(s, i, "g", [f"r{i}", "x,\"y"]) for i, s in enumerate(scenarios)]
    given = spark.createDataFrame(rows, "scenario string, case_idx bigint, groundtruth string, pred_rc array<string>").withColumn("mode", F.lit("tree"))
    out = str(tmp_path / "out")
    assert tables.write_predictions(given, spark.createDataFrame([("r",)], "run string"), out, "all") == [f"{out}/{f}" for f in ("parquet", "jsonl", "csv")]
    schema = "case_idx bigint, groundtruth string, pred_rc array<string>, mode string, scenario string"
    lines = spark.read.schema(schema).json(f"{out}/jsonl").orderBy("case_idx").collect()
    assert [(r.scenario, r.case_idx, r.groundtruth, r.pred_rc, r["mode"]) for r in lines] == [(s or None, i, g, p, "tree") for s, i, g, p in rows]
    csv = spark.read.option("header", "true").option("escape", '"').csv(f"{out}/csv").select("case_idx", F.from_json("pred_rc", "array<string>").alias("p"))
    assert sorted((int(r.case_idx), r.p) for r in csv.collect()) == [(i, p) for _s, i, _g, p in rows]


SF_DIR = "/root/testdata/sf0.001"


def files_below(root) -> int:
    return sum(len(names) for _folder, _folders, names in os.walk(str(root).removeprefix("file:")))


def test_a_tree_is_deleted(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('a', id % 3, '/x/', id, '.json') AS path", "'{}' AS body")
    write_named_files(rows, f"{tmp_path}/t").collect()
    assert files_below(f"{tmp_path}/t") == 300
    delete_tree(spark, f"{tmp_path}/t")
    assert not os.path.exists(f"{tmp_path}/t")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_backfill_keeps_only_a_part_of_its_source_files(spark, monkeypatch):
    seen = {}
    read = labels.read_label_documents

    def watched(session, root):
        seen.setdefault(root, []).append(files_below(root))
        return read(session, root)

    monkeypatch.setattr(plans.labels, "read_label_documents", watched)
    monkeypatch.setattr(files, "FILES_AT_ONCE", 300)
    query = plans.registry
    result = oracle.compare(spark, oracle.connect(SF_DIR), query.queries["file_backfill"], query.sql["file_backfill"], SF_DIR)
    assert result["ok"], result["note"]
    (sources, counts), = [x for x in seen.items() if x[0].endswith("/sources")]
    assert len(counts) == 4 and max(counts) < 400 and sum(counts) == 1020
    assert not os.path.exists(sources)


def test_replaced_rows_that_repeat_stay_or_go(spark, tmp_path, monkeypatch):
    form = "role string, scenario string, round int, case_idx bigint, sample string, text string"
    out = f"{tmp_path}/answers"

    def store(*rows):
        tables.write_responses(spark.createDataFrame(list(rows), form), out)

    def stored():
        return sorted((r.role, r.scenario or "", r.case_idx, r.text) for r in spark.read.parquet(out).collect())

    store(*[("a", "s", 0, i, "", "x") for i in range(4)], ("a", None, 0, 1, None, "x"), ("a", None, 0, 1, None, "x"))
    assert stored() == [("a", "", 1, "x"), *[("a", "s", i, "x") for i in range(4)]]
    store(("a", "s", 0, 9, "", "y"), ("a", "s", 0, 9, "", "y"))  # nothing is replaced
    assert stored() == [("a", "", 1, "x"), *[("a", "s", i, "x") for i in range(4)], ("a", "s", 9, "y")]
    store(("a", "s", 0, 9, "", "z"), ("a", None, 0, 1, None, "z"))  # some are
    assert stored() == [("a", "", 1, "z"), *[("a", "s", i, "x") for i in range(4)], ("a", "s", 9, "z")]
    monkeypatch.setattr(store_module, "FEW_PARTITIONS", 1)
    store(*[("a", "s", 0, i, "", "w") for i in (0, 1, 2, 3, 9)], ("b", "s", 0, 1, "", "w"))  # all of one partition are
    assert stored() == [("a", "", 1, "z"), *[("a", "s", i, "w") for i in (0, 1, 2, 3, 9)], ("b", "s", 1, "w")]


def test_repeated_writes_do_not_shuffle_whole_rows(spark, tmp_path, monkeypatch):
    """Only keys are exchanged: no plan of a rewrite that replaces everything has the text below an exchange."""
    rows = spark.range(2000).selectExpr("'a' AS role", "concat('s', id % 5) AS scenario", "0 AS round", "id AS case_idx", "'' AS sample", "repeat(uuid(), 20) AS text")
    fixed = store_module.materialize(rows, "fixed")
    plans_seen = []
    writer = type(fixed.write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **b: (plans_seen.append(self._df._jdf.queryExecution().optimizedPlan().toString()), parquet(self, path, *a, **b))[1])
    for _ in range(2):
        tables.write_prompts(fixed, str(tmp_path / "out"))
    assert len(plans_seen) == 4
    assert not [p for p in plans_seen if "RebalancePartitions" in p or "Aggregate" in p or "Join" in p]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


def test_lines_and_csv_are_compressed(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'m' AS mode", "concat('s', id % 2) AS scenario", "id AS case_idx", "array('Brand#1', 'Brand#2') AS pred_rc", "'Brand#1' AS groundtruth")
    meta = spark.createDataFrame([("r",)], "run string")
    sizes, texts = {}, {}
    for compression in ("gzip", "none"):
        out = tmp_path / compression
        tables.write_predictions(rows, meta, str(out), "all", **({} if compression == "gzip" else {"compression": compression}))
        for form in ("jsonl", "csv"):
            parts = [p for p in (out / form).rglob("part-*")]
            assert all(p.name.endswith(".gz") == (compression == "gzip") for p in parts)
            sizes[form, compression] = sum(p.stat().st_size for p in parts)
            texts[form, compression] = sorted(r.value for r in spark.read.text(str(out / form)).collect())
    for form in ("jsonl", "csv"):
        assert sizes[form, "gzip"] * 4 < sizes[form, "none"] and set(texts[form, "gzip"]) == set(texts[form, "none"])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_ingest_keeps_only_a_part_of_the_files(spark, monkeypatch):
    seen = []
    load = labels.load_cases

    def watched(session, root, new):
        seen.append((root, files_below(root)))
        return load(session, root, new)

    monkeypatch.setattr(plans.labels, "load_cases", watched)
    monkeypatch.setattr(files, "FILES_AT_ONCE", 600)
    query = plans.registry
    result = oracle.compare(spark, oracle.connect(SF_DIR), query.queries["file_ingest"], query.sql["file_ingest"], SF_DIR)
    assert result["ok"], result["note"]
    assert len(seen) == 2 and sum(n for _root, n in seen) == 1000 and max(n for _root, n in seen) < 600
    assert not os.path.exists(seen[0][0])
