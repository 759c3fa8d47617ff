"""The flow from documents to predictions takes every new case, under trees of the default depth."""

import os

import pytest
from pyspark.sql import functions as F
from test_tree import grow

from caseflow import vocab
from caseflow.operators import flow
from caseflow.plans import catalog, documents, windows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def walk(nodes, x):
    node = 1
    while nodes[node][0] is not None:
        feature, threshold, _counts = nodes[node]
        node = 2 * node + (x[feature] > threshold)
    return node


def test_every_new_case_against_exhaustive_trees(spark):
    rows = [(s, sel["log"], sel["kpi"]) for s, sel in documents.SCENARIO_SELECTIONS.items()]
    selections = spark.createDataFrame(rows, "scenario string, log array<string>, kpi map<string,array<string>>")
    arrays, _names = flow.selected_arrays(documents.cases(spark, SF_DIR), selections, ("scenario", "idx", "root_cause"))
    arrays = arrays.withColumn("features", F.col("features").cast("array<float>").cast("array<double>"))
    marks = {r.folder: r.last_index for r in windows.checkpoints(spark, SF_DIR).filter("mode = 'tree_infer'").collect()}
    cases = {}
    for r in arrays.collect():
        cases.setdefault(r.scenario, []).append((r.idx, r.features, r.root_cause or ""))

    want = {}
    for scenario, found in cases.items():
        found.sort()
        new = [c for c in found if c[0] > marks.get(scenario, -1)]
        train = [(x, label) for idx, x, label in found if new and idx < new[0][0] and label][-vocab.TRAIN_N :]
        if not train:
            continue
        nodes = grow(train, vocab.MIN_SAMPLES_LEAF, vocab.MAX_DEPTH)
        for idx, x, label in new:
            leaf = walk(nodes, x)
            best = min(nodes[leaf][2].items(), key=lambda item: (-item[1], item[0]))[0]
            want[scenario, idx] = (leaf, best, label == best if label else None, new[-1][0])
    got = catalog.queries()["tree_flow_all"](spark, SF_DIR).collect()
    assert {(r.scenario, r.idx): (r.leaf, r.pred_top1_rc, r.is_correct, r.last_index) for r in got} == want
    assert len(got) == len(want) > 160
    assert max(leaf for leaf, *_rest in want.values()) > 3


def test_selected_values_equal_the_maps_without_building_them(spark):
    cases = documents.cases(spark, SF_DIR).filter("idx < 60")
    rows = [(s, sel["log"], sel["kpi"]) for s, sel in documents.SCENARIO_SELECTIONS.items() if s != "view"] + [("error ", None, None)]
    selections = spark.createDataFrame(rows, "scenario string, log array<string>, kpi map<string,array<string>>")
    arrays, names = flow.selected_arrays(cases, selections)
    assert "map_from_entries" not in arrays._jdf.queryExecution().optimizedPlan().toString()
    maps = {r.idx: r.features for r in flow.feat.select_features(cases, selections).collect()}
    assert len(maps) == 60 and {r.idx: r.features for r in arrays.collect()} == {i: [m.get(n) or 0.0 for n in names] for i, m in maps.items()}
