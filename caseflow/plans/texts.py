"""Prompt budgets and truncation on documents, selections out of answers, KPI segments of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions import kpi as K
from caseflow.functions.text import render, truncate_middle
from caseflow.operators import prompts, selection
from caseflow.plans.common import Registry, r6, table

registry = Registry()


@registry.add("""SELECT doc_id, md5(CASE WHEN length(text) > 900 THEN left(text, 450) || E'\\n\\n[...]\\n\\n' || right(text, 450) ELSE text END) AS digest
FROM documents""")
def truncated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = truncate_middle(F.col("text"), 900, "\n\n[...]\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cut).alias("digest"))


@registry.add("""SELECT doc_id, md5('Type {x}: ' || source || chr(10) || text || ' / ' || lang || '.') AS digest FROM documents""")
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that looks like a place is not filled again."""
    fields = {"kind": F.col("source"), "body": F.col("text"), "lang": F.col("lang")}
    text = render("Type {{x}}: {kind}\n{body} / {lang}.", fields)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("digest"))


# Budget 3000: the logs are the text of every third document (JSON text), the rest is head and tail.
BUDGET = 3000
ROOM = BUDGET - len(vocab.PROMPT_CUT_MARK)
SQL_OVERHEAD = """length('{"__truncated__":true,"__note__":"anomaly_logs 超出 Prompt token 预算，仅保留首尾内容","__original_token_count__":')
  + length(length(logs)::VARCHAR) + length(',"__head__":"","__tail__":""}')"""


@registry.add(f"""WITH parts AS (
  SELECT doc_id, 'Source ' || source || ': ' || CASE WHEN doc_id % 3 = 2 THEN text ELSE '' END AS before,
         CASE WHEN doc_id % 3 < 2 THEN replace(replace(replace(text, '"', ''), '\\', ''), chr(10), ' ') END AS logs,
         CASE WHEN doc_id % 3 = 1 THEN text ELSE ' end' END AS after FROM documents),
sized AS (SELECT *, length(before) + coalesce(length(logs), 0) + length(after) AS original_tokens, length(before) + length(after) AS rest FROM parts),
decided AS (SELECT *,
  before || CASE WHEN coalesce(length(logs), 0) > 0 THEN '{{"__truncated__":true,"__note__":"{vocab.LOG_CUT_NOTE}","__original_token_count__":'
    || length(logs) || ',"__head__":"","__tail__":""}}' ELSE coalesce(logs, '') END || after AS shrunk,
  original_tokens > {BUDGET} AS truncated,
  CASE WHEN original_tokens <= {BUDGET} THEN 'none'
       WHEN coalesce(length(logs), 0) = 0 OR rest + {SQL_OVERHEAD} > {BUDGET} THEN 'whole_prompt_fallback' ELSE 'anomaly_logs' END AS truncation_strategy
  FROM sized)
SELECT doc_id, original_tokens, truncated, truncation_strategy,
  CASE truncation_strategy WHEN 'none' THEN original_tokens WHEN 'whole_prompt_fallback' THEN {BUDGET}
    ELSE rest + {SQL_OVERHEAD} + least({BUDGET} - rest - ({SQL_OVERHEAD}), length(logs) - 1) END AS final_tokens,
  CASE truncation_strategy WHEN 'none' THEN md5(before || coalesce(logs, '') || after)
    WHEN 'whole_prompt_fallback' THEN md5(left(shrunk, {ROOM // 2}) || '{vocab.PROMPT_CUT_MARK}' || right(shrunk, {ROOM - ROOM // 2})) ELSE
      md5(before || '{{"__truncated__":true,"__note__":"anomaly_logs 超出 Prompt token 预算，仅保留首尾内容","__original_token_count__":' || length(logs)
        || ',"__head__":"' || left(logs, least({BUDGET} - rest - ({SQL_OVERHEAD}), length(logs) - 1) // 2)
        || '","__tail__":"' || right(logs, least({BUDGET} - rest - ({SQL_OVERHEAD}), length(logs) - 1) - least({BUDGET} - rest - ({SQL_OVERHEAD}), length(logs) - 1) // 2)
        || '"}}' || after) END AS digest
FROM decided""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace(F.regexp_replace(F.col("text"), r'["\\]', ""), "\n", " ")
    kind = F.col("doc_id") % 3
    parts = docs.select(
        "doc_id",
        F.concat(F.lit("Source "), "source", F.lit(": "), F.when(kind == 2, F.col("text")).otherwise("")).alias("before"),
        F.when(kind < 2, plain).alias("logs_json"),
        F.when(kind == 1, F.col("text")).otherwise(" end").alias("after"),
    )
    fitted = prompts.fit_prompts(parts, BUDGET)
    return fitted.select(
        "doc_id", F.col("original_tokens").cast("bigint").alias("original_tokens"), "truncated", "truncation_strategy",
        F.col("final_tokens").cast("bigint").alias("final_tokens"), F.md5("prompt").alias("digest"),
    )


def _sql_cut(text: str, kept: str) -> str:
    return f"""('{{"__truncated__":true,"__note__":"{vocab.LOG_CUT_NOTE}","__original_token_count__":' || length({text}) || ',"__head__":"'
      || left({text}, {kept} // 2) || '","__tail__":"' || right({text}, {kept} - {kept} // 2) || '"}}')"""


@registry.add(f"""WITH plain AS (
  SELECT doc_id, source, replace(replace(replace(replace(text, '"', ''), '\\', ''), chr(10), ' '), chr(9), ' ') AS t FROM documents),
parts AS (
  SELECT doc_id, 'Source ' || coalesce(source, '') || ': ' AS a, coalesce(CASE WHEN doc_id % 4 = 0 THEN left(t, 1500) ELSE t END, '') AS x,
         ' and ' AS m, coalesce(CASE WHEN doc_id % 4 < 2 THEN t WHEN doc_id % 4 = 2 THEN left(t, 700) ELSE '' END, '') AS y,
         CASE WHEN doc_id % 5 = 0 THEN repeat('z', 2800) ELSE ' end' END AS b FROM plain),
ordered AS (
  SELECT *, length(a) + length(x) + length(m) + length(y) + length(b) AS total, length(x) > length(y) AS x_first,
         CASE WHEN length(x) > length(y) THEN x ELSE y END AS big, CASE WHEN length(x) > length(y) THEN y ELSE x END AS small FROM parts),
one AS (SELECT *, total - length(big) AS rest1, length({_sql_cut("big", "0")}) AS empty1, length({_sql_cut("small", "0")}) AS empty2 FROM ordered),
two AS (
  SELECT *, CASE WHEN total > {BUDGET} AND big <> '' THEN greatest(least({BUDGET} - rest1 - empty1, length(big) - 1), 0) END AS k1,
         rest1 + empty1 - length(small) AS rest2 FROM one),
three AS (
  SELECT *, CASE WHEN k1 IS NOT NULL AND rest1 + empty1 > {BUDGET} AND small <> '' THEN greatest(least({BUDGET} - rest2 - empty2, length(small) - 1), 0) END AS k2 FROM two),
texts AS (
  SELECT *, CASE WHEN k1 IS NULL THEN big ELSE {_sql_cut("big", "k1")} END AS big_, CASE WHEN k2 IS NULL THEN small ELSE {_sql_cut("small", "k2")} END AS small_ FROM three),
whole AS (SELECT *, a || CASE WHEN x_first THEN big_ ELSE small_ END || m || CASE WHEN x_first THEN small_ ELSE big_ END || b AS p FROM texts)
SELECT doc_id, total::BIGINT AS original_tokens, least(length(p), {BUDGET})::BIGINT AS final_tokens,
  CASE WHEN length(p) > {BUDGET} THEN 'whole_prompt_fallback' WHEN k1 IS NOT NULL THEN 'anomaly_logs' ELSE 'none' END AS truncation_strategy,
  ((k1 IS NOT NULL)::INT + (k2 IS NOT NULL)::INT)::INT AS truncated_sections, CASE WHEN k1 IS NOT NULL THEN k1 + coalesce(k2, 0) END::BIGINT AS retained_log_tokens,
  md5(CASE WHEN length(p) > {BUDGET} THEN left(p, {ROOM // 2}) || '{vocab.PROMPT_CUT_MARK}' || right(p, {ROOM - ROOM // 2}) ELSE p END) AS digest
FROM whole""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with two log blocks: the larger one is cut first, the other one only if that is not enough."""
    text = F.regexp_replace(F.regexp_replace(F.col("text"), r'["\\]', ""), r"[\n\t]", " ")
    kind = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents")
    shaped = docs.select(
        "doc_id",
        F.array(
            prompts.part(F.concat(F.lit("Source "), F.coalesce("source", F.lit("")), F.lit(": "))),
            prompts.part(F.when(kind == 0, F.left(text, F.lit(1500))).otherwise(text), True),
            prompts.part(F.lit(" and ")),
            prompts.part(F.when(kind < 2, text).when(kind == 2, F.left(text, F.lit(700))), True),
            prompts.part(F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("z"), F.lit(2800))).otherwise(" end")),
        ).alias("parts"),
    )
    fitted = prompts.fit_parts(shaped, BUDGET)
    return fitted.select(
        "doc_id", "original_tokens", "final_tokens", "truncation_strategy", "truncated_sections", "retained_log_tokens", F.md5("prompt").alias("digest")
    )


# --- selections -------------------------------------------------------------------------------
# Answers about a brand, one per part, in the order of the part key; p_partkey % 5 decides their shape.
SELECTION_TEXT = """CASE p_partkey % 5
  WHEN 0 THEN concat('no json for ', p_name)
  WHEN 1 THEN concat('think </think> ```json {"kpi": 1} ``` then ```JSON {"log": ["', p_type, '", "flash_count", "', p_type,
    '"], "kpi": {"traffic_in": ["max"], "temperature": ["bad", "mean", "mix", "mean"], "cpu_utilization": "alarming"}}```')
  WHEN 2 THEN concat('{"json": {"log": "', p_type, '", "kpi": {"traffic_out": ["alarming", "duration", "min"]}}, "size": ', p_size, '} ok')
  WHEN 3 THEN '```json [[{"log": 1}], [{"log": [], "kpi": []}]] ```'
  ELSE '{"log": ["a"], "kpi": {' END"""


def selection_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_brand").alias("scenario"), F.col("p_partkey").alias("pos"), F.expr(SELECTION_TEXT).alias("text"))


@registry.add("""SELECT p_partkey, 1 + p_partkey % 8 AS lists, p_type AS log FROM part""")
def deep_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer inside one to eight lists, next to other values, is found."""
    lists = F.expr("1 + p_partkey % 8")
    body = F.concat(F.lit('{"log": ["'), "p_type", F.lit('"], "kpi": {}}'))
    text = F.concat(F.lit("so ```json "), F.repeat(F.lit("["), lists), F.lit("0, "), body, F.repeat(F.lit("]"), lists), F.lit(" ```"))
    answers = table(spark, sf_dir, "part").select("p_partkey", lists.alias("lists"), text.alias("text"))
    found = selection.first_selection(selection.parse_answer(F.col("text"))["json"])
    return answers.select("p_partkey", "lists", F.try_variant_get(found, "$.log[0]", "string").alias("log"))


def shown_selection(df: DataFrame) -> DataFrame:
    s = F.col("selection")
    return df.select("scenario", F.array_join(s["log"], "|").alias("log"), *[F.array_join(s["kpi"][k], "|").alias(k) for k in vocab.KPIS])


SQL_SELECTION = """picked AS (
  SELECT p_brand AS scenario, p_partkey, p_type FROM part WHERE p_partkey % 5 BETWEEN 1 AND 3
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1),
shown AS (
  SELECT scenario, CASE p_partkey % 5 WHEN 1 THEN p_type || '|flash_count' WHEN 2 THEN p_type ELSE 'template_occur_count' END AS log,
    CASE p_partkey % 5 WHEN 1 THEN 'max|mix' ELSE 'mix|mean' END AS traffic_in,
    CASE p_partkey % 5 WHEN 2 THEN 'alarming|duration|min' ELSE 'mix|mean' END AS traffic_out,
    'mix|mean' AS drop_packet_rate, 'mix|mean' AS error_packet_rate, 'mix|mean' AS offline_loss_rate,
    CASE p_partkey % 5 WHEN 1 THEN 'alarming|mean' ELSE 'mix|mean' END AS cpu_utilization, 'mix|mean' AS memory_utilization,
    CASE p_partkey % 5 WHEN 1 THEN 'mean|mix' ELSE 'mix|mean' END AS temperature
  FROM picked)"""


@registry.add(f"WITH {SQL_SELECTION} SELECT * FROM shown")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_selection(selection.selections_from_answers(selection_answers(spark, sf_dir)))


@registry.add(f"""WITH {SQL_SELECTION}, brands AS (SELECT DISTINCT p_brand AS scenario FROM part),
usable AS (SELECT DISTINCT p_brand AS scenario FROM part WHERE p_partkey % 5 BETWEEN 1 AND 3 AND p_size > 48)
SELECT scenario, usable.scenario IS NULL AS fell_back FROM brands LEFT JOIN usable USING (scenario)""")
def selection_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only answers on large parts count; brands without a usable one keep the previous selection."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_size") > 48)
    answers = parts.select(F.col("p_brand").alias("scenario"), F.col("p_partkey").alias("pos"), F.expr(SELECTION_TEXT).alias("text"))
    previous = selection.selections_from_answers(selection_answers(spark, sf_dir))
    merged = selection.with_fallback(selection.selections_from_answers(answers), previous)
    return merged.select("scenario", F.col("fallback_reason").isNotNull().alias("fell_back"))


# --- KPI segments -----------------------------------------------------------------------------
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding is cut into four segments of 16 values; starts and the alarm depend on the row."""
    vectors = table(spark, sf_dir, "embeddings")

    def segment(i):
        start = F.lit(1_700_000_000.0) + i * 1000 + (F.col("vec_id") * 37) % 700
        return F.struct(
            start.alias("start_time"),
            (start + 60.0 * (1 + (F.col("vec_id") + i) % 9)).alias("end_time"),
            F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")).alias("value"),
            F.lit("p").alias("pattern"),
        )

    alarm = F.when(F.col("vec_id") % 5 != 0, F.lit(1.7e12) + (F.col("vec_id") * 7919) % 4_500_000)
    return vectors.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), segment).alias("segments"), alarm.alias("alarm"))


SQL_SEGMENTS = """segs AS (
  SELECT vec_id, i, 1700000000.0::DOUBLE + i * 1000 + (vec_id * 37) % 700 AS s,
         1700000000.0::DOUBLE + i * 1000 + (vec_id * 37) % 700 + 60.0 * (1 + (vec_id + i) % 9) AS e,
         list_slice(embedding, i * 16 + 1, i * 16 + 16)::DOUBLE[] AS v,
         CASE WHEN vec_id % 5 <> 0 THEN (1700000000000.0::DOUBLE + (vec_id * 7919) % 4500000) / 1000 END AS alarm_at
  FROM embeddings, (SELECT unnest(range(0, 4)) AS i))"""


@registry.add(f"""WITH {SQL_SEGMENTS}
SELECT vec_id, round(max(list_max(v)), 6) AS top, round(min(list_min(v)), 6) AS low, round(avg(list_avg(v)), 6) AS mean,
       round((max(e) - min(s)) / 60, 6) AS duration,
       round(sign(avg(list_avg(v))) * ln(1 + abs(avg(list_avg(v)))), 6) AS scaled FROM segs GROUP BY 1""")
def kpi_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_rows(spark, sf_dir).withColumn("values", K.all_values(F.col("segments")))
    stats = K.value_stats(F.col("values"))
    return rows.select(
        "vec_id", r6(stats["max"], "top"), r6(stats["min"], "low"), r6(stats["mean"], "mean"),
        r6(K.overall_duration(F.col("segments")), "duration"), r6(K.signed_log(stats["mean"]), "scaled"),
    )


@registry.add(f"""WITH {SQL_SEGMENTS},
near AS (
  SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY
    CASE WHEN alarm_at IS NULL THEN -e WHEN alarm_at BETWEEN s AND e THEN 0 ELSE least(abs(alarm_at - s), abs(alarm_at - e)) END, i) = 1)
SELECT vec_id, round(s, 3) AS start_time, round((e - s) / 60, 6) AS minutes, round(list_max(v), 6) AS top, round(list_avg(v), 6) AS mean FROM near""")
def nearest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment_rows(spark, sf_dir).withColumn("near", K.nearest_segment(F.col("segments"), F.col("alarm")))
    stats = K.value_stats(F.col("near.value"))
    return rows.select(
        "vec_id", F.round("near.start_time", 3).alias("start_time"), r6(K.segment_minutes(F.col("near")), "minutes"),
        r6(stats["max"], "top"), r6(stats["mean"], "mean"),
    )
