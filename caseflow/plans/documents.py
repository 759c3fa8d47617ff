"""Case documents: every event becomes one JSON label document, written row-wise as text.

scenario = event type, idx = event id. The document fields are arithmetic on the event id, its value and
its `k` property, and take all the shapes the operators must cope with: objects or texts for root causes,
logs as object or JSON text, missing and odd values. The SQL twins compute the features from the columns
without any document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.logs import flash_count as flash_count_of
from caseflow.operators import features as feat
from caseflow.operators import rounds
from caseflow.plans.common import Registry, joined, table
from caseflow.scale import materialize, spread
from caseflow.sources import labels

registry = Registry()

EPOCH = 1_700_000_000
# Documents that one task builds and opens.
DOCUMENTS_PER_TASK = 1 << 14


# --- the document as Spark SQL text -----------------------------------------------------------
def _counts(section_rule) -> str:
    """JSON object text of template counters; a template is left out where its rule says so."""
    entries = ", ".join(
        f"CASE WHEN {present} THEN concat('\"{name}\":', {count}) END" for name, present, count in section_rule
    )
    return f"concat('{{', concat_ws(',', {entries}), '}}')"


def _section_rules() -> dict[str, list[tuple[str, str, str]]]:
    exc, fla = list(enumerate(vocab.EXCEPTION_TEMPLATES)), list(enumerate(vocab.FLASH_TEMPLATES))
    return {
        "local_exception": [(t, f"e % {i + 2} <> 0", f"(e * {i + 3}) % 7") for i, t in exc],
        "remote_exception": [(t, f"e % {i + 3} <> 1", f"(e * {i + 5}) % 9") for i, t in exc],
        "local_flash": [(t, f"e % {i + 2} <> 1", f"(e * {i + 2}) % 6") for i, t in fla],
        "remote_flash": [(t, f"e % {i + 4} <> 2", f"(e * {i + 7}) % 5") for i, t in fla],
    }


def _segment(j: int, s: int) -> tuple[str, str, list[str]]:
    start = f"({EPOCH} + {s * 1000} + (e * {j + 1}) % 500)"
    end = f"({start} + 60 * (1 + (e + {s}) % 10))"
    return start, end, [f"(v * {s + 1})", f"(v - {j})", f"(k * {s + 1} / 8.0D)"]


def _kpi(j: int, name: str) -> str:
    def segment(s: int) -> str:
        start, end, values = _segment(j, s)
        listed = ", ',', ".join(values)
        return (
            f"CASE WHEN {s} <= (e + {j}) % 3 THEN concat('{{\"start_time\":', {start}, ',\"end_time\":', {end}, "
            f"',\"value\":[', {listed}, '],\"pattern\":\"levelUp\"}}') END"
        )

    segments = ", ".join(segment(s) for s in range(3))
    return f"""CASE (e + {j}) % 6 WHEN 0 THEN NULL
      WHEN 1 THEN '"{name}":{{"upper_bound":1,"abnormal_timing_segments":[]}}'
      ELSE concat('"{name}":{{"upper_bound":1.5,"abnormal_timing_segments":[', concat_ws(',', {segments}), ']}}') END"""


def _cases(selector: str, *texts: str | None) -> str:
    """CASE over `selector` with one JSON text per value; None leaves the key out."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if t is None else t}" for i, t in enumerate(texts))
    return f"CASE {selector} {arms} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def document_sql() -> str:
    rules = _section_rules()
    sections = ", ',', ".join(f"'\"{name}\":', {_counts(rule)}" for name, rule in rules.items())
    shutdown = (
        """',"local_shutdown":', CASE WHEN e % 3 = 0 THEN '{"user":"u","time":1}' ELSE '{}' END, """
        """',"remote_shutdown":', CASE WHEN e % 4 = 0 THEN '{"user":"w"}' ELSE '{}' END"""
    )
    logs = f"concat('{{', {sections}, {shutdown}, '}}')"
    # Every ninth document carries its logs as a JSON string.
    logs = f"CASE WHEN e % 9 = 0 THEN to_json(parse_json(concat('\"', replace({logs}, '\"', '\\\\\"'), '\"'))) ELSE {logs} END"
    kpis = f"concat('{{', concat_ws(',', {', '.join(_kpi(j, n) for j, n in enumerate(vocab.KPIS))}), '}}')"
    # The lambda also keeps this text out of whole-stage code, where it is one method that is too long for the JVM to compile.
    netstreams = "CASE WHEN e % 5 = 0 THEN '{}' ELSE concat('[', array_join(transform(array_repeat('a', CAST(e % 4 AS INT)), x -> concat('{\"source\":\"', x, '\"}')), ','), ']') END"

    def obj(*fields: str) -> str:
        return f"concat('{{', concat_ws(',', {', '.join(fields)}), '}}')"

    echo = obj(
        _cases("e % 3", "'\"BGP_protocol_status\":\"Established\"'", "'\"BGP_protocol_status\":\"Idle\"'", "'\"BGP_protocol_status\":{}'"),
        _cases("e % 6", *[_quoted(f'"local_interface_status":{x}') for x in ('"UP"', "null", '"ERROR DOWN"', '"Administratively DOWN"', "{}")], None),
        _cases("e % 5", *[_quoted(f'"remote_interface_status":{x}') for x in ("{}", '"UP"', '"down"')], None, _quoted('"remote_interface_status":null')),
        _cases("e % 4", f"concat('\"sys_running_time\":', {EPOCH}000 + (e * 53) % 8000000 - 4000000)", *[_quoted(f'"sys_running_time":{x}') for x in ('""', "-5", "12.5")]),
    )
    local = obj(
        "CASE WHEN e % 2 = 0 THEN '\"owner\":\"XDCN1\"' ELSE '\"owner\":\"IT\"' END",
        _cases("e % 4", *[_quoted(f'"resource_status":{x}') for x in ('"Running"', '""', "null", '"Stopped"')]),
    )
    remote = obj("CASE WHEN e % 3 = 0 THEN '\"owner\":\"DCN\"' END", "CASE WHEN e % 5 = 0 THEN '\"resource_status\":\"Off\"' END")
    device = obj(
        f"concat('\"local_device\":', {local})",
        f"concat('\"remote_device\":', {remote})",
        _cases("e % 3", *[_quoted(f'"local_ifname":{x}') for x in ('"Vlanif12"', '"GE1/0"', "{}")]),
        _cases("e % 4", *[_quoted(f'"local_server_status":{x}') for x in ("{}", '{"life_cycle_status":"使用中"}', '{"life_cycle_status":"报废"}')], None),
    )
    sem = obj(
        f"concat('\"anomaly_logs\":', {logs})",
        f"concat('\"anomaly_kpi\":', {kpis})",
        f"concat('\"anomaly_netstreams\":', {netstreams})",
        f"concat('\"other_info\":{{\"command_echo_info\":', {echo}, ',\"device_info\":', {device}, '}}')",
        f"CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN '\"alarm_time\":\"x\"' WHEN 2 THEN concat('\"alarm_time\":', {EPOCH} + (e * 37) % 3000) "
        f"ELSE concat('\"alarm_time\":', {EPOCH}000 + (e * 37) % 3000000) END",
        _cases("e % 6", *[_quoted(f'"sop":{x}') for x in ('"do x"', '"  "', '{"step":1}', "[]", "null")], None),
    )
    return obj(
        f"concat('\"semantic_labels\":', {sem})",
        f"CASE WHEN e % 7 > 2 THEN concat('\"alarm_time\":', {EPOCH}000 + (e * 37) % 3000000) END",
        "CASE WHEN e % 2 = 0 THEN '\"sop\":\"top \"' END",
        _cases(
            "e % 5",
            "concat('\"root_cause\":{\"category\":\"c', k % 10, ' \",\"description\":\"d\"}')",
            "concat('\"root_cause\":{\"category\":\"\",\"name\":\"n', k % 10, '\"}')",
            "concat('\"root_cause\":\" s', k % 10, '\"')",
            "concat('\"root_cause\":{\"root_cause\":\"r', k % 10, '\"}')",
            None,
        ),
        _cases(
            "e % 4",
            "concat('\"root_cause_candidates\":[{\"category\":\"c', k % 10, '\"},{\"category\":\" c1\"},{\"category\":\"c1\"},{\"name\":\"z\"}]')",
            "concat('\"root_cause_candidates\":[\"a \",\"\",\"s', k % 10, '\",\"a\"]')",
            _quoted('"root_cause_candidates":[]'),
            None,
        ),
    )


def case_documents(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    """scenario, idx, body (JSON text), doc, of all events or of those that `only` names."""
    events = table(spark, sf_dir, "events").filter(only).select(
        F.col("event_type").alias("scenario"),
        F.col("event_id").alias("e"),
        F.col("value").alias("v"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
    )
    events = spread(events, DOCUMENTS_PER_TASK)
    return labels.with_document(events.select("scenario", F.col("e").alias("idx"), F.expr(document_sql()).alias("body")))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.project_cases(case_documents(spark, sf_dir))


# --- SQL twins --------------------------------------------------------------------------------
SQL_EVENTS = "ev AS (SELECT event_type AS scenario, event_id AS e, value AS v, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events)"

SQL_TOP = "CASE WHEN e % 2 = 0 THEN 'top' ELSE '' END"
SQL_SOP = f"CASE e % 6 WHEN 0 THEN 'do x' WHEN 2 THEN '{{\"step\":1}}' WHEN 3 THEN '' ELSE {SQL_TOP} END"
SQL_ROOT = "CASE e % 5 WHEN 0 THEN 'c' || k % 10 || ' ' WHEN 1 THEN 'n' || k % 10 WHEN 2 THEN ' s' || k % 10 WHEN 3 THEN 'r' || k % 10 ELSE '' END"


@registry.add(f"""WITH {SQL_EVENTS}
SELECT scenario, e AS idx, CASE WHEN e % 7 > 2 THEN ({EPOCH}000 + (e * 37) % 3000000)::DOUBLE END AS alarm_time_ms,
  {SQL_SOP} AS sop,
  CASE e % 4 WHEN 0 THEN '{{"category":"c' || k % 10 || '"}}|{{"category":" c1"}}|{{"category":"c1"}}|{{"name":"z"}}'
    WHEN 1 THEN 'a ||s' || k % 10 || '|a' ELSE {SQL_ROOT} END AS candidates,
  CASE e % 4 WHEN 0 THEN CASE WHEN k % 10 = 1 THEN 'c1' ELSE 'c' || k % 10 || '|c1' END WHEN 1 THEN 'a|s' || k % 10 ELSE '' END AS categories,
  {SQL_ROOT} AS root_cause,
  CASE e % 5 WHEN 0 THEN 'c' || k % 10 WHEN 2 THEN 's' || k % 10 ELSE '' END AS groundtruth
FROM ev""")
def case_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select(
        "scenario", "idx", "alarm_time_ms", "sop", joined(F.col("candidates"), "candidates"), joined(F.col("categories"), "categories"),
        "root_cause", "groundtruth",
    )


@registry.add(f"""WITH {SQL_EVENTS}
SELECT scenario, e AS idx, CASE WHEN {SQL_SOP} = '' THEN 'cooperation' ELSE 'competition' END AS mode FROM ev""")
def routed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.route(cases(spark, sf_dir)).select("scenario", "idx", "mode")


@registry.add(f"""WITH {SQL_EVENTS},
texts AS (SELECT scenario, e, e % 13 = 0 AS broken FROM ev)
SELECT scenario, count(*) AS n, count(*) FILTER (broken) AS quarantined FROM texts GROUP BY 1""")
def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 13th document loses its last brace; it goes to quarantine and not into the cases."""
    docs = case_documents(spark, sf_dir)
    cut = F.when(F.col("idx") % 13 == 0, F.left("body", F.length("body") - 1)).otherwise(F.col("body"))
    good, bad = labels.split_bad(labels.with_document(docs.select("scenario", "idx", cut.alias("body"))))
    marked = good.select("scenario", F.lit(0).alias("q")).unionByName(bad.select("scenario", F.lit(1).alias("q")))
    return marked.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("quarantined"))


def _sql_counter(rule: tuple[str, str, str]) -> str:
    _name, present, count = rule
    return f"CASE WHEN {present} THEN {count} ELSE 0 END"


def _sql_log(x: str) -> str:
    return f"(sign({x}) * ln(1 + abs({x})))"


def _sql_kpi(j: int, token: str, stat: str) -> str:
    """KPI feature from columns: segments as a list of structs built per row."""
    segments = ", ".join(
        f"{{'s': {_segment(j, s)[0]}, 'e': {_segment(j, s)[1]}, 'v': [{', '.join(x.replace('8.0D', '8.0::DOUBLE') for x in _segment(j, s)[2])}]}}"
        for s in range(3)
    )
    listed = f"CASE WHEN (e + {j}) % 6 < 2 THEN [] ELSE list_slice([{segments}], 1, (e + {j}) % 3 + 1) END"
    if token == "mix":
        values = f"flatten(list_transform({listed}, lambda x: x.v))"
        duration = f"(list_max(list_transform({listed}, lambda x: x.e)) - list_min(list_transform({listed}, lambda x: x.s))) / 60.0::DOUBLE"
    else:
        at = f"CASE WHEN e % 7 < 2 THEN NULL WHEN e % 7 = 2 THEN ({EPOCH} + (e * 37) % 3000)::DOUBLE ELSE ({EPOCH}000 + (e * 37) % 3000000) / 1000.0::DOUBLE END"
        gap = (
            f"CASE WHEN ({at}) IS NULL THEN -x.e::DOUBLE WHEN ({at}) BETWEEN x.s AND x.e THEN 0.0 "
            f"ELSE least(abs(({at}) - x.s), abs(({at}) - x.e)) END"
        )
        gaps = f"list_transform({listed}, lambda x: {gap})"
        near = f"({listed})[list_position({gaps}, list_min({gaps}))]"
        values, duration = f"{near}.v", f"({near}.e - {near}.s) / 60.0::DOUBLE"
    number = {"max": f"list_max({values})", "min": f"list_min({values})", "mean": f"list_avg({values})", "duration": duration}[stat]
    filled = f"coalesce({number}, 0)::DOUBLE"
    return f"round({_sql_log(filled)}, 6)"


def _sql_features() -> dict[str, str]:
    """Feature name -> SQL over ev, for the full set."""
    rules = _section_rules()
    out: dict[str, str] = {}
    for section in vocab.EXCEPTION_SECTIONS + vocab.FLASH_SECTIONS:
        for rule in rules[section]:
            out[f"anomaly_logs-{section}-{rule[0]}"] = _sql_counter(rule)
    for section in vocab.FLASH_SECTIONS:
        by_name = {r[0]: _sql_counter(r) for r in rules[section]}
        pairs = ", ".join(f"least({by_name[a]}, {by_name[b]})" for a, b in vocab.FLASH_PAIRS)
        out[f"anomaly_logs-{section}_count"] = f"greatest({pairs}, {by_name[vocab.FLASH_SINGLE]})"
    out["anomaly_logs-local_shutdown"] = "CASE WHEN e % 3 = 0 THEN 1 ELSE 0 END"
    out["anomaly_logs-remote_shutdown"] = "CASE WHEN e % 4 = 0 THEN 1 ELSE 0 END"
    out["anomaly_netstreams-count"] = "CASE WHEN e % 5 = 0 THEN 0 ELSE e % 4 END"
    for j, name in enumerate(vocab.KPIS):
        for token in vocab.SEGMENT_TOKENS:
            for stat in vocab.STAT_TOKENS:
                out[f"anomaly_kpi-{name}-{stat}_{token}"] = _sql_kpi(j, token, stat)
    head, dev = "other_info-command_echo_info", "other_info-device_info"
    running = f"CASE e % 4 WHEN 0 THEN ({EPOCH}000 + (e * 53) % 8000000 - 4000000)::DOUBLE WHEN 2 THEN -5.0 WHEN 3 THEN 12.5 END"
    alarm = f"CASE WHEN e % 7 = 2 THEN ({EPOCH} + (e * 37) % 3000)::DOUBLE WHEN e % 7 > 2 THEN ({EPOCH}000 + (e * 37) % 3000000)::DOUBLE END"
    out[f"{head}-BGP_protocol_status"] = "CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END"
    out[f"{head}-local_interface_status"] = "CASE e % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END"
    out[f"{head}-remote_interface_status"] = "CASE e % 5 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 1 END"
    out[f"{head}-sys_running_time-login_status"] = f"CASE WHEN ({running}) >= 0 THEN 0 ELSE 1 END"
    out[f"{head}-sys_running_time-reboot_status"] = f"CASE WHEN ({running}) - ({alarm}) + 3600000 > 0 THEN 0 ELSE 1 END"
    out[f"{dev}-local_device-owner"] = "CASE WHEN e % 2 = 0 THEN 0 ELSE 1 END"
    out[f"{dev}-local_device-resource_status"] = "CASE WHEN e % 4 = 3 THEN 1 ELSE 0 END"
    out[f"{dev}-remote_device-owner"] = "CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END"
    out[f"{dev}-remote_device-resource_status"] = "CASE WHEN e % 5 = 0 THEN 1 ELSE 0 END"
    out[f"{dev}-local_ifname"] = "CASE WHEN e % 3 = 0 THEN 1 ELSE 0 END"
    out[f"{dev}-local_server_status-life_cycle_status"] = "CASE WHEN e % 4 = 2 THEN 1 ELSE 0 END"
    return out


def short_names(selection) -> dict[str, str]:
    """Feature name -> f000, f001, ... in feature order (plain SQL column names)."""
    return {name: f"f{i:03d}" for i, name in enumerate(feat.feature_names(selection))}


def _feature_sql(selection) -> str:
    sql = _sql_features()
    columns = ", ".join(f"({sql[name]})::DOUBLE AS {short}" for name, short in short_names(selection).items())
    return f"WITH {SQL_EVENTS} SELECT scenario, e AS idx, {columns} FROM ev"


def _features(spark: SparkSession, sf_dir: str, selection) -> DataFrame:
    wide = feat.extract_features(cases(spark, sf_dir), selection)
    return wide.select("scenario", "idx", *[F.round(F.col(f"`{n}`"), 6).alias(s) for n, s in short_names(selection).items()])


@registry.add(_feature_sql(feat.DEFAULT_SELECTION))
def default_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, feat.DEFAULT_SELECTION)


@registry.add(_feature_sql(feat.FULL_SELECTION))
def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, feat.FULL_SELECTION)


SCENARIO_SELECTIONS = {
    "click": {"log": ["CMDRECORD", "flash_count"], "kpi": {"traffic_in": ["mix", "max"]}},
    "error": {"log": ["template_occur_count", "hwPortDown(l)", "REBOOT"], "kpi": {"temperature": ["alarming", "duration"]}},
    "view": {"log": ["template_occur_count"], "kpi": {"traffic_out": ["alarming", "min"], "cpu_utilization": ["mix", "mean"]}},
    "purchase": {"log": ["SHUTDOWN"], "kpi": {"memory_utilization": ["mix", "min"]}},
    "signup": {"log": ["CMDRECORD"], "kpi": {}},
}


def _selected_names(selection) -> list[str]:
    return feat.feature_names({"log": selection["log"], "kpi": {k: selection["kpi"].get(k, []) for k in vocab.KPIS}})


def _selected_sql() -> str:
    sql = _sql_features()
    arms = []
    for scenario, selection in SCENARIO_SELECTIONS.items():
        names = _selected_names(selection)
        total = " + ".join(f"({sql[n]})::DOUBLE" for n in names)
        arms.append(f"SELECT scenario, e AS idx, {len(names)} AS n, round({total}, 3) AS total FROM ev WHERE scenario = '{scenario}'")
    return f"WITH {SQL_EVENTS} " + " UNION ALL ".join(arms)


@registry.add(_selected_sql())
def scenario_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features under one selection per scenario: their number and sum per case."""
    rows = [(s, sel["log"], sel["kpi"]) for s, sel in SCENARIO_SELECTIONS.items()]
    selections = materialize(spark.createDataFrame(rows, "scenario string, log array<string>, kpi map<string,array<string>>"), "selections")
    picked = feat.select_features(cases(spark, sf_dir), selections)
    total = F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return picked.select("scenario", "idx", F.size("features").alias("n"), F.round(total, 3).alias("total"))


def _top_sql(limit: int) -> str:
    sql = _sql_features()
    pairs = ", ".join(f"{{'name': '{n}', 'value': ({sql[n]})::DOUBLE}}" for n in feat.feature_names(feat.DEFAULT_SELECTION))
    return f"""WITH {SQL_EVENTS},
long AS (SELECT scenario, e AS idx, unnest([{pairs}]) AS p FROM ev),
ranked AS (SELECT scenario, idx, p.name AS name, p.value AS value,
                  row_number() OVER (PARTITION BY scenario, idx ORDER BY abs(p.value) DESC, p.name) AS pos FROM long WHERE p.value <> 0)
SELECT scenario, idx, pos::INT AS pos, name, value FROM ranked WHERE pos <= {limit}"""


@registry.add(_top_sql(3))
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = feat.extract_features(cases(spark, sf_dir))
    rounded = wide.select("scenario", "idx", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns[2:]])
    top = feat.top_features(rounded, limit=3)
    # The outer form: for the plain one the planner adds a filter that repeats the whole feature list.
    placed = top.select("scenario", "idx", F.posexplode_outer("top").alias("pos", "t")).filter(F.col("pos").isNotNull())
    return placed.select("scenario", "idx", (F.col("pos") + 1).alias("pos"), "t.name", "t.value")


# --- kernels on plain columns -----------------------------------------------------------------
@registry.add("""WITH c AS (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
         count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase,
         count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1)
SELECT user_id, greatest(least(click, view), least(signup, purchase), error) AS flash_count FROM c""")
def flash_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flash count over event counters per user: (click, view) and (signup, purchase) are the pairs."""
    kinds = ("click", "view", "signup", "purchase", "error")
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    value = flash_count_of(lambda name: F.col(name), pairs=(("click", "view"), ("signup", "purchase")), single="error")
    return counted.select("user_id", value.alias("flash_count"))


@registry.add("""SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS class_id FROM customer""")
def encoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.label_encode(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
