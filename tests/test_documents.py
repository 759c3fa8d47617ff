from pyspark.sql import functions as F

from caseflow.functions import kpi, logs, variants
from caseflow.operators import features
from caseflow.plans import documents

SF = "/root/testdata/sf0.001"


def test_selections_do_not_move_documents(spark):
    """Rows of a scenario are not dealt to one task to meet its selection, which is one row."""
    plan = documents.scenario_features(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_document_text_is_compiled(spark):
    """The text is neither interpreted as a whole inside a lambda nor one method of whole-stage code."""
    plan = documents.case_documents(spark, SF).select("body")._jdf.queryExecution().executedPlan().toString()
    assert "knownnotcontainsnull" not in plan.lower() and "transform(array_repeat" in plan


def test_odd_sections_and_segments(spark):
    texts = [
        '{"s":{"a":2.9,"b":"3","c":null,"d":[1]},"k":{"anomaly_kpi":{"x":{"abnormal_timing_segments":[{"start_time":1,"value":[1,"2"]},{"value":"no"}]}}}}',
        '{"s":[1],"k":{}}',
        '"text"',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.parse_json("t"))
    section = logs.counters(F.col("v"), "s")
    counted = rows.select("i", *[logs.counter(section, n).alias(n) for n in "abcd"]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in counted] == [(2, 3, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    segments = rows.select("i", kpi.segments_of(F.try_variant_get("v", "$.k", "variant"), "x").alias("s")).orderBy("i").collect()
    assert [x["value"] for x in segments[0]["s"]] == [[1.0, 2.0], []] and segments[1]["s"] is None and segments[2]["s"] is None
    kinds = rows.select("i", variants.is_object(F.col("v")).alias("o"), variants.is_string(F.col("v")).alias("s")).orderBy("i").collect()
    assert [(r.o, r.s) for r in kinds] == [(True, False), (True, False), (False, True)]


def test_objects_are_not_copied_out_of_the_document(spark):
    plan = documents.top_features(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "['device_info']['local_ifname'], VariantType" in plan
    assert "['device_info'], VariantType" not in plan and "['command_echo_info'], VariantType" not in plan
    assert "['local_shutdown'], MapType(StringType,VariantType" not in plan and "array_sort" not in plan


def test_logs_as_text_and_odd_segments_in_features(spark):
    """Logs as object, as JSON text and of other kinds; segments without values or times."""
    logs_text = '{"local_flash":{"PEER_STATE_CHG(l)":2},"local_shutdown":{"a":null,"b":[1]}}'
    segments = '[{"start_time":0,"end_time":60,"value":[1,"3",null]},{"start_time":60,"value":"no"},7,{"end_time":180}]'
    sems = [
        f'{{"anomaly_logs":{logs_text},"anomaly_kpi":{{"traffic_in":{{"abnormal_timing_segments":{segments}}}}}}}',
        '{"anomaly_logs":"' + logs_text.replace('"', '\\"') + '"}',
        '{"anomaly_logs":"null","other_info":{"device_info":{"local_ifname":"Vlanif1"}}}',
        f'{{"anomaly_logs":[{logs_text}],"other_info":{{"device_info":[{{"local_ifname":"Vlanif1"}}]}}}}',
        '{"anomaly_logs":"x","anomaly_kpi":{"traffic_in":{"abnormal_timing_segments":{}}}}',
        "{}",
    ]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(sems)], "scenario string, idx int, t string")
    selection = {"log": ["template_occur_count", "PEER_STATE_CHG(l)"], "kpi": {"traffic_in": ["mix", "alarming", "max", "duration"]}}
    wide = features.extract_features(rows.withColumn("sem", F.parse_json("t")), selection).orderBy("idx").collect()
    names = ["anomaly_logs-local_flash-PEER_STATE_CHG(l)", "anomaly_logs-local_shutdown", "other_info-device_info-local_ifname"]
    assert [tuple(r[n] for n in names) for r in wide] == [(2, 1, 0), (2, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    kpis = [[round(r[f"anomaly_kpi-traffic_in-{s}"], 6) for s in ("max_mix", "duration_mix", "max_alarming")] for r in wide]
    assert kpis == [[1.386294, 0.693147, 0.0]] + [[0.0, 0.0, 0.0]] * 5
