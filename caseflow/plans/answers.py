"""Answer parsing: responses written from the brands of an order, and conversations as rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import after_think
from caseflow.operators import answers, prompts, repair
from caseflow.plans.common import Registry, joined, table
from caseflow.plans.ranking import SQL_BRANDS, rankings
from caseflow.scale import materialize

registry = Registry()

# The response text of an order by case_idx % 6. by_price / by_quantity are rankings, `first` the top brand.
#   0 JSON array after a shorter decoy   1 single quotes with a trailing ellipsis   2 objects with category
#   3 only mentions                      4 nothing usable                           5 two equal lengths, the last wins
SPARK_TEXT = """CASE case_idx % 6
  WHEN 0 THEN concat('thinking ["', by_price[0], '"] </think> Ranking: ["', array_join(by_price, '", "'), '"] done [1, 2] [see above')
  WHEN 1 THEN concat('Ranking “by hand”: [\\'', array_join(by_price, '\\', \\''), '\\', ...] end')
  WHEN 2 THEN concat('Result [{"category": " ', array_join(by_price, '"}, {"category": "'), ' "}, ["', by_price[0], '"], 7] end')
  WHEN 3 THEN concat('I suspect ', array_join(by_price, '; '), '</think> Finally ', array_join(by_quantity, ', then '), '.')
  WHEN 4 THEN 'No [idea] at all'
  ELSE concat('["', array_join(by_price, '","'), '"] or rather ["', array_join(by_quantity, '","'), '"]') END"""

SQL_TEXT = """CASE case_idx % 6
  WHEN 3 THEN 'Finally ' || replace(by_quantity, '|', ', then ') || '.' ELSE '' END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, case_idx, groundtruth, candidates (brands by name) and the response text."""
    ranked = rankings(spark, sf_dir).withColumnRenamed("tree", "by_price").withColumnRenamed("competition", "by_quantity")
    return ranked.select(
        "scenario", "case_idx", "groundtruth", F.array_sort("by_price").alias("candidates"), F.expr(SPARK_TEXT).alias("text")
    )


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`responses`, written once: cases, predictions and answers are all read from it, each with its own columns."""
    return materialize(responses(spark, sf_dir), "responses")


SQL_ANSWERS = SQL_BRANDS + f""",
wide AS (
  SELECT p.case_idx, p.pred AS by_price, q.pred AS by_quantity, groundtruth, o_orderpriority AS scenario
  FROM lists p JOIN lists q ON q.method = 'competition' AND q.case_idx = p.case_idx
  JOIN truth t ON t.case_idx = p.case_idx JOIN orders ON o_orderkey = p.case_idx WHERE p.method = 'tree'),
said AS (SELECT *, {SQL_TEXT} AS closing FROM wide),
mentions AS (
  SELECT case_idx, string_agg(brand, '|' ORDER BY strpos(closing, brand), brand) AS mentioned
  FROM said JOIN brands USING (case_idx) WHERE case_idx % 6 = 3 GROUP BY 1),
parsed AS (
  SELECT scenario, case_idx, groundtruth,
    CASE case_idx % 6 WHEN 3 THEN mentioned WHEN 4 THEN '' WHEN 5 THEN by_quantity ELSE by_price END AS pred,
    CASE case_idx % 6 WHEN 3 THEN 'candidate_text_fallback' WHEN 4 THEN 'unparsed' ELSE 'structured_array' END AS strategy
  FROM said LEFT JOIN mentions USING (case_idx))"""


@registry.add(f"WITH {SQL_ANSWERS} SELECT scenario, case_idx, pred AS pred_rc, strategy AS parse_strategy FROM parsed")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers.parse_answers(responses(spark, sf_dir))
    return parsed.select("scenario", "case_idx", joined(F.col("pred_rc"), "pred_rc"), "parse_strategy")


def as_verifier(rows: DataFrame) -> DataFrame:
    """Responses of the verifier; reasoner texts beside them must not be used."""
    verifier = rows.select("scenario", "case_idx", F.lit("verifier").alias("role"), F.lit(None).cast("int").alias("round"), "text")
    other = rows.select("scenario", "case_idx", F.lit("competition").alias("role"), F.lit(None).cast("int").alias("round"), F.lit('["x"]').alias("text"))
    return verifier.unionByName(other)


@registry.add(f"""WITH {SQL_ANSWERS},
ranked AS (SELECT *, list_position(string_split(pred, '|'), groundtruth) AS pos FROM parsed)
SELECT scenario, case_idx, pred AS pred_rc, nullif(split_part(pred, '|', 1), '') AS pred_top1_rc,
  CASE WHEN strategy = 'unparsed' THEN strategy ELSE 'competition_reasoner:' || strategy END AS parse_strategy,
  (CASE WHEN pos > 0 THEN pos END)::INT AS rank, CASE WHEN strategy = 'structured_array' THEN 1 ELSE 2 END AS attempts
FROM ranked""")
def competition_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_responses(spark, sf_dir)
    results = answers.method_results(rows.drop("text"), as_verifier(rows), "competition")
    return results.select(
        "scenario", "case_idx", joined(F.col("pred_rc"), "pred_rc"), "pred_top1_rc", "parse_strategy", "rank",
        F.size("parse_attempts").alias("attempts"),
    )


@registry.add(f"""WITH {SQL_ANSWERS}
SELECT scenario, case_idx, CASE WHEN scenario = '1-URGENT' THEN '' ELSE pred END AS pred_rc,
  CASE WHEN scenario = '1-URGENT' THEN 'missing_scenario_output_dir' WHEN strategy = 'unparsed' THEN strategy
       ELSE 'competition_reasoner:' || strategy END AS parse_strategy
FROM parsed""")
def rescored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved answers parsed again; urgent orders have no run directory."""
    rows = stored_responses(spark, sf_dir)
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scenario")).distinct()
    runs = runs.select(
        F.lit("competition").alias("method"), "scenario",
        F.when(F.col("scenario") != "1-URGENT", F.concat(F.lit("/runs/"), F.col("scenario"))).alias("output_dir"),
    )
    saved = rows.select(F.lit("competition").alias("method"), "scenario", "case_idx")
    results = answers.rescore(saved, rows.drop("text"), as_verifier(rows), runs, "competition")
    return results.select("scenario", "case_idx", joined(F.col("pred_rc"), "pred_rc"), "parse_strategy")


@registry.add(f"""WITH {SQL_ANSWERS}
SELECT scenario, case_idx, CASE WHEN strategy = 'unparsed' THEN 'rerun:unparsed' ELSE 'rerun:competition_reasoner:' || strategy END AS parse_strategy,
  (pred <> '') AS parsed
FROM parsed""")
def reparsed_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_responses(spark, sf_dir)
    results = repair.mark_rerun(answers.method_results(rows.drop("text"), as_verifier(rows), "competition"))
    return results.select("scenario", "case_idx", "parse_strategy", (F.size("pred_rc") > 0).alias("parsed"))


# --- conversations as rounds ------------------------------------------------------------------
WORDS = ("the", "le", "que", "un", "an")


def meta_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are Meta answers of rounds; a turn with id % 5 = 3 was prepared but failed."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return turns.select(
        F.lit("chat").alias("scenario"),
        F.col("conv_id").alias("case_idx"),
        F.lit("meta").alias("role"),
        F.col("turn").cast("int").alias("round"),
        F.when(F.col("turn") % 5 != 3, F.col("text")).alias("text"),
    )


SQL_LAST = """last AS (
  SELECT conv_id AS case_idx, turn::INT AS round, CASE WHEN turn % 5 <> 3 THEN text END AS text
  FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"""


@registry.add(f"WITH {SQL_LAST} SELECT case_idx, round, md5(text) AS digest FROM last")
def last_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.last_meta(meta_responses(spark, sf_dir)).select("case_idx", "round", F.md5("text").alias("digest"))


@registry.add(f"""WITH {SQL_LAST},
words AS (SELECT unnest(['the', 'le', 'que', 'un', 'an']) AS word),
hits AS (
  SELECT case_idx, string_agg(word, '|' ORDER BY strpos(right(text, 6000), word), word) AS pred
  FROM last, words WHERE strpos(right(text, 6000), word) > 0 GROUP BY 1)
SELECT case_idx, coalesce(pred, '') AS pred_rc,
       CASE WHEN pred IS NULL THEN 'unparsed' ELSE 'cooperation_meta:round' || round || ':candidate_text_fallback' END AS parse_strategy
FROM last LEFT JOIN hits USING (case_idx)""")
def cooperation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = meta_responses(spark, sf_dir)
    cases = rounds.select("scenario", "case_idx").distinct().withColumn("candidates", F.array(*[F.lit(w) for w in WORDS]))
    results = answers.method_results(cases.withColumn("groundtruth", F.lit("the")), rounds, "cooperation")
    return results.select("case_idx", joined(F.col("pred_rc"), "pred_rc"), "parse_strategy")


@registry.add("""WITH turns AS (
  SELECT conv_id AS case_idx, (turn // 2)::INT AS round, max(text) FILTER (role <> 'assistant') AS meta, max(text) FILTER (role = 'assistant') AS reasoner
  FROM conversations GROUP BY 1, 2),
cut AS (
  SELECT case_idx, round, CASE WHEN length(meta) > 9000 THEN left(meta, 4500) || E'\\n\\n[...日志过长，中间部分已截断...]\\n\\n' || right(meta, 4500) ELSE meta END AS meta,
    CASE WHEN length(reasoner) > 9000 THEN left(reasoner, 4500) || E'\\n\\n[...日志过长，中间部分已截断...]\\n\\n' || right(reasoner, 4500) ELSE reasoner END AS reasoner
  FROM turns),
before AS (
  SELECT case_idx, round, lag(meta) OVER w AS meta, lag(reasoner) OVER w AS reasoner FROM cut WINDOW w AS (PARTITION BY case_idx ORDER BY round))
SELECT case_idx, round, md5(CASE WHEN meta IS NULL AND reasoner IS NULL THEN '无上一轮输出。'
  ELSE concat_ws(E'\\n\\n', '[Last Meta]' || chr(10) || meta, '[Last Reasoner]' || chr(10) || reasoner) END) AS digest FROM before""")
def round_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns make a round: the question is the Meta text, the answer the reasoner text."""
    turns = table(spark, sf_dir, "conversations")
    assistant = F.col("role") == "assistant"
    rounds = turns.groupBy(
        F.lit("chat").alias("scenario"), F.col("conv_id").alias("case_idx"), F.expr("CAST(turn div 2 AS INT)").alias("round")
    ).agg(F.max(F.when(~assistant, F.col("text"))).alias("meta"), F.max(F.when(assistant, F.col("text"))).alias("reasoner"))
    return prompts.with_round_context(rounds).select("case_idx", "round", F.md5("last_round_outputs").alias("digest"))


@registry.add(f"""WITH {SQL_BRANDS},
texts AS (SELECT case_idx, max(pred) FILTER (method = 'tree') AS a, max(pred) FILTER (method = 'competition') AS b,
          max(pred) FILTER (method = 'cooperation') AS c FROM lists GROUP BY 1)
SELECT case_idx, md5('=== Reasoner1 ===' || chr(10) || a || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10) ||
  '=== Reasoner2 ===' || chr(10) || b || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10) ||
  '=== Reasoner3 ===' || chr(10) || c || chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10)) AS digest FROM texts""")
def merged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rankings(spark, sf_dir)
    samples = F.array(
        *[
            F.struct(F.lit(name).alias("sample"), F.array_join(method, "|").alias("text"))
            for (name, _t, _p), method in zip(vocab.SAMPLERS, ("tree", "competition", "cooperation"))
        ]
    )
    long = rows.select("scenario", "case_idx", F.explode(samples).alias("s")).select("scenario", "case_idx", "s.*")
    return prompts.merge_samples(long).select("case_idx", F.md5("text").alias("digest"))


@registry.add("SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE 'x' END) AS digest FROM conversations")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part after the last end-of-thinking tag."""
    thought = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("a</think>b</think>"), F.col("text"))).otherwise(
        F.concat(F.col("text"), F.lit("</think>x"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(after_think(thought)).alias("digest"))
