"""Case features from `sem` (VARIANT): log counters, netstreams, KPI statistics, device status.

A selection says which features to compute: {"log": [template, ...], "kpi": {kpi: [token, ...]}}. With one
selection for all cases only the selected expressions are in the plan. With a selection per scenario
(`select_features`) the full set is computed and masked row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions import kpi as K
from caseflow.functions import logs as L
from caseflow.functions import status as S
from caseflow.functions.variants import child, get, number_of, path_of, string_of

DEFAULT_SELECTION = {"log": [vocab.TEMPLATE_COUNTS], "kpi": {kpi: ["mix", "mean"] for kpi in vocab.KPIS}}
FULL_SELECTION = {
    "log": [*vocab.EXCEPTION_TEMPLATES, vocab.TEMPLATE_COUNTS, *vocab.FLASH_TEMPLATES, vocab.FLASH_COUNT],
    "kpi": {kpi: [*vocab.SEGMENT_TOKENS, *vocab.STAT_TOKENS] for kpi in vocab.KPIS},
}
from caseflow.scale import range_parts, same_key_join


def parsed_logs(sem: Column) -> Column:
    """The log object of a document that gives it as JSON text, else null. A log object is tested in place, not copied."""
    path = path_of("anomaly_logs")
    nested = get(sem, path, "struct<>").isNotNull() | get(sem, path, "array<struct<>>").isNotNull()
    return F.try_parse_json(F.when(~nested, string_of(child(sem, "anomaly_logs"))))


def log_parts(sem: Column, parsed: Column) -> list[Column]:
    """Counters of every section, which the features of a section share. Logs given as text have no section in `sem`."""
    return [
        F.coalesce(L.counters(parsed, s), L.counters(sem, "anomaly_logs", s)).alias(f"_log_{s}")
        for s in vocab.EXCEPTION_SECTIONS + vocab.FLASH_SECTIONS
    ]


def log_features(sem: Column, parsed: Column, selected: Sequence[str]) -> dict[str, Column]:
    """Log features over the document, its `parsed_logs` and the columns of `log_parts`."""
    out: dict[str, Column] = {}
    for section in vocab.EXCEPTION_SECTIONS:
        for template in vocab.EXCEPTION_TEMPLATES:
            if template in selected:
                out[f"anomaly_logs-{section}-{template}"] = L.counter(F.col(f"_log_{section}"), template)
    if vocab.TEMPLATE_COUNTS in selected:
        for section in vocab.FLASH_SECTIONS:
            for template in vocab.FLASH_TEMPLATES:
                if template in selected:
                    out[f"anomaly_logs-{section}-{template}"] = L.counter(F.col(f"_log_{section}"), template)
    if vocab.FLASH_COUNT in selected:
        for section in vocab.FLASH_SECTIONS:
            out[f"anomaly_logs-{section}_count"] = L.flash_count(lambda name, s=section: L.counter(F.col(f"_log_{s}"), name))
    for section in vocab.SHUTDOWN_SECTIONS:
        out[f"anomaly_logs-{section}"] = F.greatest(L.has_content(parsed, section), L.has_content(sem, "anomaly_logs", section))
    return out


def netstream_features(sem: Column) -> dict[str, Column]:
    items = F.size(get(sem, "$.anomaly_netstreams", "array<variant>"))
    return {"anomaly_netstreams-count": F.when(items > 0, items).otherwise(F.lit(0))}


def kpi_parts(name: str, tokens: Sequence[str], segments: Column, alarm_time: Column) -> list[Column]:
    """What the statistics of one KPI share: all values, the overall duration, the nearest segment."""
    parts = []
    if "mix" in tokens:
        parts += [K.all_values(segments).alias(f"_all_{name}"), K.overall_duration(segments).alias(f"_span_{name}")]
    if "alarming" in tokens:
        parts.append(K.nearest_segment(segments, alarm_time).alias(f"_near_{name}"))
    return parts


def kpi_features(selected: Mapping[str, Sequence[str]], log_scale: bool = True) -> dict[str, Column]:
    """Statistics over the columns of `kpi_parts`."""
    scale = K.signed_log if log_scale else (lambda x: x.cast("double"))
    out: dict[str, Column] = {}
    for name in vocab.KPIS:
        tokens = selected.get(name, ())
        for token in vocab.SEGMENT_TOKENS:
            if token not in tokens:
                continue
            if token == "mix":
                stats = {**K.value_stats(F.col(f"_all_{name}")), "duration": F.col(f"_span_{name}")}
            else:
                nearest = F.col(f"_near_{name}")
                stats = {**K.value_stats(nearest["value"]), "duration": K.segment_minutes(nearest)}
            for stat in vocab.STAT_TOKENS:
                if stat in tokens:
                    out[f"anomaly_kpi-{name}-{stat}_{token}"] = scale(stats[stat])
    return out


def other_features(sem: Column) -> dict[str, Column]:
    # Whole paths: taking an object out of a document copies it.
    def echo(name: str) -> Column:
        return child(sem, "other_info", "command_echo_info", name)

    def device(*names: str) -> Column:
        return child(sem, "other_info", "device_info", *names)

    running = echo("sys_running_time")
    head, dev = "other_info-command_echo_info", "other_info-device_info"
    out = {
        f"{head}-BGP_protocol_status": S.bgp_down(echo("BGP_protocol_status")),
        f"{head}-local_interface_status": S.interface_code(echo("local_interface_status")),
        f"{head}-remote_interface_status": S.interface_code(echo("remote_interface_status")),
        f"{head}-sys_running_time-login_status": S.not_logged_in(running),
        f"{head}-sys_running_time-reboot_status": S.rebooted(running, child(sem, "alarm_time")),
    }
    for side in ("local_device", "remote_device"):
        out[f"{dev}-{side}-owner"] = S.foreign_owner(device(side, "owner"))
        out[f"{dev}-{side}-resource_status"] = S.resource_abnormal(device(side, "resource_status"))
    out[f"{dev}-local_ifname"] = S.is_vlan(device("local_ifname"))
    out[f"{dev}-local_server_status-life_cycle_status"] = S.life_cycle_abnormal(device("local_server_status", "life_cycle_status"))
    return out


OTHER_FEATURES = (
    "other_info-command_echo_info-BGP_protocol_status",
    "other_info-command_echo_info-local_interface_status",
    "other_info-command_echo_info-remote_interface_status",
    "other_info-command_echo_info-sys_running_time-login_status",
    "other_info-command_echo_info-sys_running_time-reboot_status",
    "other_info-device_info-local_device-owner",
    "other_info-device_info-local_device-resource_status",
    "other_info-device_info-remote_device-owner",
    "other_info-device_info-remote_device-resource_status",
    "other_info-device_info-local_ifname",
    "other_info-device_info-local_server_status-life_cycle_status",
)


def feature_rules() -> list[tuple[str, str, str, str, str]]:
    """(name, kind, a, b, c) of every feature in order; kind and a, b, c say what switches it on.

    log: template a is listed. flash: so is the template-count switch. kpi: tokens b and c of KPI a.
    """
    rules = [
        (f"anomaly_logs-{s}-{t}", "log", t, "", "") for s in vocab.EXCEPTION_SECTIONS for t in vocab.EXCEPTION_TEMPLATES
    ]
    rules += [(f"anomaly_logs-{s}-{t}", "flash", t, "", "") for s in vocab.FLASH_SECTIONS for t in vocab.FLASH_TEMPLATES]
    rules += [(f"anomaly_logs-{s}_count", "log", vocab.FLASH_COUNT, "", "") for s in vocab.FLASH_SECTIONS]
    rules += [(f"anomaly_logs-{s}", "always", "", "", "") for s in vocab.SHUTDOWN_SECTIONS]
    rules.append(("anomaly_netstreams-count", "always", "", "", ""))
    rules += [
        (f"anomaly_kpi-{k}-{stat}_{token}", "kpi", k, token, stat)
        for k in vocab.KPIS
        for token in vocab.SEGMENT_TOKENS
        for stat in vocab.STAT_TOKENS
    ]
    return rules + [(name, "always", "", "", "") for name in OTHER_FEATURES]


def feature_names(selection: Mapping) -> list[str]:
    """Names of the features of a selection, in order."""
    log, kpis = selection["log"], selection["kpi"]
    switched = {
        "always": lambda a, b, c: True,
        "log": lambda a, b, c: a in log,
        "flash": lambda a, b, c: a in log and vocab.TEMPLATE_COUNTS in log,
        "kpi": lambda a, b, c: b in kpis.get(a, ()) and c in kpis.get(a, ()),
    }
    return [name for name, kind, *abc in feature_rules() if switched[kind](*abc)]


def extract_features(cases: DataFrame, selection: Mapping = DEFAULT_SELECTION, keep=("scenario", "idx")) -> DataFrame:
    """Wide feature table (DOUBLE columns) in the order logs, netstreams, KPI, other info.

    Shared parts of the document (log object, KPI segments, nearest segment) are columns of two projections
    below the features, so each is computed once per case.
    """
    sem = F.col("sem")
    used = {k: selection["kpi"].get(k, ()) for k in vocab.KPIS if set(selection["kpi"].get(k, ())) & set(vocab.SEGMENT_TOKENS)}
    alarm = get(sem, "$.alarm_time", "variant")
    opened = cases.select(
        *keep,
        "sem",
        parsed_logs(sem).alias("_logs"),
        number_of(alarm).alias("_alarm"),
        *[K.timed_values(sem, k).alias(f"_seg_{k}") for k in used],
    )
    parts = [p for k, tokens in used.items() for p in kpi_parts(k, tokens, F.col(f"_seg_{k}"), F.col("_alarm"))]
    shared = opened.select(*keep, "sem", "_logs", *log_parts(sem, F.col("_logs")), *parts)
    columns = {
        **log_features(sem, F.col("_logs"), selection["log"]),
        **netstream_features(sem),
        **kpi_features(used),
        **other_features(sem),
    }
    return shared.select(*keep, *[c.cast("double").alias(name) for name, c in columns.items()])


def _switches(selections: DataFrame) -> DataFrame:
    """(scenario, _on): for every feature whether the selection switches it on. Found once per row of `selections`, not per case."""
    rules = F.array(
        *[F.struct(*[F.lit(x).alias(n) for n, x in zip(("name", "kind", "a", "b", "c"), rule)]) for rule in feature_rules()]
    )

    def chosen(r: Column) -> Column:
        by_log = (r["kind"] == "log") & F.array_contains("log", r["a"])
        by_flash = (r["kind"] == "flash") & F.array_contains("log", r["a"]) & F.array_contains("log", F.lit(vocab.TEMPLATE_COUNTS))
        tokens = F.col("kpi")[r["a"]]
        by_kpi = (r["kind"] == "kpi") & F.array_contains(tokens, r["b"]) & F.array_contains(tokens, r["c"])
        return (r["kind"] == "always") | F.coalesce(by_log, F.lit(False)) | F.coalesce(by_flash, F.lit(False)) | F.coalesce(by_kpi, F.lit(False))

    return selections.select("scenario", F.transform(rules, chosen).alias("_on"))


def _on() -> Column:
    """Switches of a case: without a selection, as with an empty one, only the features that are always there are on."""
    return F.coalesce("_on", F.array(*[F.lit(kind == "always") for _name, kind, *_abc in feature_rules()]))


def select_features(cases: DataFrame, selections: DataFrame, keep=("scenario", "idx")) -> DataFrame:
    """Feature map per case under its scenario's selection (scenario, log array, kpi map of arrays)."""
    full = extract_features(cases, FULL_SELECTION, keep)
    joined = full.join(_switches(selections), "scenario", "left")
    zipped = F.arrays_zip(
        F.array(*[F.lit(rule[0]) for rule in feature_rules()]).alias("name"),
        F.array(*[F.col(f"`{n}`") for n in full.columns if n not in keep]).alias("value"),
        _on().alias("on"),
    )
    kept = F.filter(zipped, lambda z: z["on"])
    return joined.select(*keep, F.map_from_entries(F.transform(kept, lambda z: F.struct(z["name"], z["value"]))).alias("features"))


def all_values(cases: DataFrame, keep=("scenario", "idx")) -> tuple[DataFrame, list[str]]:
    """All features of a case as one array, with their names: written once, they serve any number of selections."""
    return as_array(extract_features(cases, FULL_SELECTION, keep), keep)


def switched_values(values: DataFrame, selections: DataFrame, keep=("scenario", "idx")) -> DataFrame:
    """The arrays of `all_values` with 0 for what the scenario's selection leaves out or what is missing."""
    joined = values.join(_switches(selections), "scenario", "left")
    masked = F.zip_with("features", _on(), lambda value, on: F.coalesce(F.when(on, value), F.lit(0.0)))
    return joined.select(*keep, masked.alias("features"))


def selected_values(cases: DataFrame, selections: DataFrame, keep=("scenario", "idx")) -> tuple[DataFrame, list[str]]:
    """`select_features` as one array over all feature names, with 0 for what is not selected or missing.

    Looking names up in the map would build it anew for every name, as the planner moves it into the lookup.
    """
    values, names = all_values(cases, keep)
    return switched_values(values, selections, keep), names


def as_array(features: DataFrame, keep=("scenario", "idx")) -> tuple[DataFrame, list[str]]:
    """Wide features as one `features` array plus the list of names, for the tree jobs."""
    names = [c for c in features.columns if c not in keep]
    return features.select(*keep, F.array(*[F.col(f"`{n}`") for n in names]).alias("features")), names


def top_features(features: DataFrame, keep=("scenario", "idx"), limit: int = vocab.FEATURES_PER_CASE) -> DataFrame:
    """Largest non-zero features of a case by absolute value, then by name. Sorted inside the row."""
    names = [c for c in features.columns if c not in keep]
    pairs = F.array(
        *[F.struct(-F.abs(F.col(f"`{n}`")).alias("o"), F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    )
    nonzero = F.filter(pairs, lambda p: p["value"] != 0)
    ranked = F.slice(F.sort_array(nonzero), 1, limit)  # no nulls; array_sort would run a comparison lambda
    return features.select(
        *keep, F.transform(ranked, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"))).alias("top")
    )


def label_classes(cases: DataFrame, label: str = "root_cause", keys: Sequence[str] = ()) -> DataFrame:
    """Class ids from 0 by sorted label. Distinct labels are ranked inside range parts, whose counts give the offsets."""
    keys = list(keys)
    distinct = cases.filter(F.col(label).isNotNull() & (F.col(label) != "")).select(*keys, label).distinct()
    parted = range_parts(distinct, [*keys, label], "labels")
    counts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(label))
    placed = same_key_join(parted, offsets, [*keys, "_part"])
    return placed.select(*keys, label, (F.col("_before") + local - 1).cast("int").alias("class_id"))


def label_encode(cases: DataFrame, label: str = "root_cause", keys: Sequence[str] = ()) -> DataFrame:
    """Add `class_id`; unlabelled rows keep null and are what `unlabelled` lists."""
    return cases.join(label_classes(cases, label, keys), [*keys, label], "left")


def unlabelled(cases: DataFrame, label: str = "root_cause") -> DataFrame:
    return cases.filter(F.col(label).isNull() | (F.col(label) == ""))
