"""Evaluation and repair on rankings of brands.

A case is an order that has lines, its scenario is the order priority. Three methods rank the order's brands
by highest price, quantity and discount; the truth is the first brand among the lines numbered 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import evaluate, problems, repair, selection
from caseflow.plans.common import Registry, joined, r6, table
from caseflow.scale import same_key_join

registry = Registry()

METHODS = (("tree", "price"), ("competition", "quantity"), ("cooperation", "discount"))


def order_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, brand) with its best price, quantity and discount."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return lines.join(parts, "l_partkey").groupBy(F.col("l_orderkey").alias("case_idx"), "brand").agg(
        F.max("l_extendedprice").alias("price"),
        F.max("l_quantity").alias("quantity"),
        F.max("l_discount").alias("discount"),
        F.max(F.col("l_linenumber") == 1).alias("leads"),
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the three rankings and the truth. A brand list has at most 25 entries."""

    def ranked(score: str):
        pairs = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col("brand"))))
        return F.transform(pairs, lambda p: p["brand"])

    per_order = order_brands(spark, sf_dir).groupBy("case_idx").agg(
        *[ranked(score).alias(method) for method, score in METHODS],
        F.min(F.when(F.col("leads"), F.col("brand"))).alias("groundtruth"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_idx"), F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("status")
    )
    return per_order.join(orders, "case_idx")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, scenario, case_idx, groundtruth, pred_rc, parse_strategy) for the three methods.

    Cooperation has no answer for orders in process; every seventh competition answer is a text fallback.
    """
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("pred_rc")) for m, _ in METHODS])
    rows = rankings(spark, sf_dir).select("scenario", "case_idx", "status", "groundtruth", F.explode(methods).alias("m"))
    method = F.col("m.method")
    blank = (method == "cooperation") & (F.col("status") == "P")
    fallback = (method == "competition") & (F.col("case_idx") % 7 == 0)
    return rows.select(
        method.alias("method"),
        "scenario",
        "case_idx",
        "status",
        "groundtruth",
        F.when(blank, F.array().cast("array<string>")).otherwise(F.col("m.pred_rc")).alias("pred_rc"),
        F.when(blank, "unparsed")
        .when(fallback, "competition_reasoner:candidate_text_fallback")
        .otherwise("structured_array")
        .alias("parse_strategy"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run times: order value per priority and year, one stage per year."""
    factor = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i + 1).alias("k")) for i, (m, _) in enumerate(METHODS)]))
    per_year = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("stage")
    ).agg(F.sum("o_totalprice").alias("value"))
    return per_year.select("scenario", "stage", "value", factor.alias("m")).select(
        "m.method", "scenario", "stage", (F.col("value") * F.col("m.k") / 1e6).alias("elapsed_seconds")
    )


SQL_BRANDS = """
brands AS (
  SELECT l_orderkey AS case_idx, p_brand AS brand, max(l_extendedprice) AS price, max(l_quantity) AS quantity,
         max(l_discount) AS discount, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS leads
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
scores AS (
  SELECT 'tree' AS method, case_idx, brand, price AS score FROM brands
  UNION ALL SELECT 'competition', case_idx, brand, quantity FROM brands
  UNION ALL SELECT 'cooperation', case_idx, brand, discount FROM brands),
placed AS (
  SELECT method, case_idx, brand, row_number() OVER (PARTITION BY method, case_idx ORDER BY score DESC, brand) AS pos
  FROM scores),
truth AS (SELECT case_idx, min(CASE WHEN leads = 1 THEN brand END) AS groundtruth FROM brands GROUP BY 1),
lists AS (SELECT method, case_idx, string_agg(brand, '|' ORDER BY pos) AS pred FROM placed GROUP BY 1, 2)"""

SQL_PREDICTIONS = SQL_BRANDS + """,
preds AS (
  SELECT l.method, o_orderpriority AS scenario, l.case_idx, o_orderstatus AS status, coalesce(t.groundtruth, '') AS groundtruth,
         CASE WHEN l.method = 'cooperation' AND o_orderstatus = 'P' THEN '' ELSE l.pred END AS pred,
         CASE WHEN l.method = 'cooperation' AND o_orderstatus = 'P' THEN NULL ELSE p.pos END AS rank,
         CASE WHEN l.method = 'cooperation' AND o_orderstatus = 'P' THEN 'unparsed'
              WHEN l.method = 'competition' AND l.case_idx % 7 = 0 THEN 'competition_reasoner:candidate_text_fallback'
              ELSE 'structured_array' END AS parse_strategy
  FROM lists l JOIN orders ON o_orderkey = l.case_idx JOIN truth t ON t.case_idx = l.case_idx
  LEFT JOIN placed p ON p.method = l.method AND p.case_idx = l.case_idx AND p.brand = t.groundtruth)"""

SQL_METRICS = """
  count(*) FILTER (groundtruth <> '') AS evaluated_count,
  round(count(*) FILTER (groundtruth <> '' AND rank <= 1) / nullif(count(*) FILTER (groundtruth <> ''), 0)::DOUBLE, 6) AS top1,
  round(count(*) FILTER (groundtruth <> '' AND rank <= 3) / nullif(count(*) FILTER (groundtruth <> ''), 0)::DOUBLE, 6) AS top3,
  round(count(*) FILTER (groundtruth <> '' AND rank <= 5) / nullif(count(*) FILTER (groundtruth <> ''), 0)::DOUBLE, 6) AS top5,
  round(coalesce(sum(1.0::DOUBLE / rank) FILTER (groundtruth <> ''), 0) / nullif(count(*) FILTER (groundtruth <> ''), 0), 6) AS mrr,
  count(*) FILTER (groundtruth <> '' AND parse_strategy = 'unparsed') AS unparsed_count"""


def rounded_metrics(df: DataFrame, *extra: str) -> DataFrame:
    ratio = {"top1", "top3", "top5", "mrr", *extra}
    return df.select(*[r6(F.col(c), c) if c in ratio else F.col(c) for c in df.columns])


@registry.add(f"""WITH {SQL_PREDICTIONS},
runs AS (
  SELECT m.method, o_orderpriority AS scenario, sum(o_totalprice) * max(m.k) / 1e6 AS elapsed
  FROM orders, (VALUES ('tree', 1), ('competition', 2), ('cooperation', 3)) AS m(method, k) GROUP BY 1, 2),
parts AS (
  SELECT method, CASE WHEN grouping(scenario) = 1 THEN 'overall' ELSE scenario END AS scope, {SQL_METRICS}
  FROM preds GROUP BY GROUPING SETS ((method, scenario), (method))),
times AS (
  SELECT method, CASE WHEN grouping(scenario) = 1 THEN 'overall' ELSE scenario END AS scope, sum(elapsed) AS elapsed
  FROM runs GROUP BY GROUPING SETS ((method, scenario), (method)))
SELECT parts.*, round(coalesce(elapsed, 0), 6) AS elapsed_seconds,
       round(coalesce(elapsed, 0) / nullif(evaluated_count, 0), 6) AS average_seconds_per_case
FROM parts LEFT JOIN times USING (method, scope)""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluate.rank_predictions(predictions(spark, sf_dir))
    return rounded_metrics(evaluate.leaderboard(ranked, runs(spark, sf_dir)), "elapsed_seconds", "average_seconds_per_case")


@registry.add(f"""WITH {SQL_PREDICTIONS},
placed_cases AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY method, scenario ORDER BY case_idx)
                     <= count(*) OVER (PARTITION BY method, scenario) // 2 THEN 'first_100' ELSE 'last_100' END AS half
  FROM preds)
SELECT method, half, CASE WHEN grouping(scenario) = 1 THEN 'overall' ELSE scenario END AS scope, {SQL_METRICS}
FROM placed_cases GROUP BY GROUPING SETS ((method, half, scenario), (method, half))""")
def half_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluate.rank_predictions(predictions(spark, sf_dir))
    return rounded_metrics(evaluate.half_metrics(ranked))


@registry.add(f"""WITH {SQL_PREDICTIONS}
SELECT method, scenario, case_idx, groundtruth, pred AS pred_rc, nullif(split_part(pred, '|', 1), '') AS pred_top1_rc,
       CASE WHEN groundtruth <> '' THEN rank END::INT AS rank, coalesce(rank = 1, false) AS is_correct, parse_strategy
FROM preds""")
def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the evaluation sees them; names arrive with blanks and repeats and are cleaned."""
    raw = predictions(spark, sf_dir)
    untidy = raw.withColumn(
        "pred_rc", F.concat(F.transform("pred_rc", lambda b: F.concat(F.lit(" "), b, F.lit("\n"))), F.col("pred_rc"), F.array(F.lit("  ")))
    )
    ranked = evaluate.rank_predictions(untidy)
    return ranked.select(
        "method", "scenario", "case_idx", "groundtruth", joined(F.col("pred_rc"), "pred_rc"), "pred_top1_rc", "rank", "is_correct", "parse_strategy"
    )


@registry.add(f"""WITH {SQL_PREDICTIONS}
SELECT method, count(*) AS processed_count, count(*) FILTER (pred <> '') AS parsed_count, count(*) FILTER (pred = '') AS unparsed_count
FROM preds GROUP BY 1""")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.parse_summary(predictions(spark, sf_dir))


@registry.add(f"""WITH {SQL_PREDICTIONS}
SELECT method, scenario, count(*) FILTER (groundtruth <> '') AS labeled_total,
       count(*) FILTER (groundtruth <> '' AND rank = 1) AS correct,
       round(count(*) FILTER (groundtruth <> '' AND rank = 1) / nullif(count(*) FILTER (groundtruth <> ''), 0)::DOUBLE, 6) AS accuracy
FROM preds GROUP BY 1, 2""")
def accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluate.rank_predictions(predictions(spark, sf_dir))
    judged = ranked.withColumn("is_correct", F.when(F.col("groundtruth") != "", F.col("is_correct")))
    scored = evaluate.accuracy(judged, ["method", "scenario"])
    return scored.withColumn("accuracy", F.round("accuracy", 6))


# --- repair -----------------------------------------------------------------------------------
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition results; finished orders have no ranking."""
    rows = predictions(spark, sf_dir).filter(F.col("method") == "competition")
    lost = F.col("status") == "F"
    return rows.select(
        "method",
        "scenario",
        F.col("scenario").alias("alarm_type"),
        "case_idx",
        F.when(lost, F.array().cast("array<string>")).otherwise(F.col("pred_rc")).alias("pred_rc"),
        F.when(lost, "unparsed").otherwise(F.col("parse_strategy")).alias("parse_strategy"),
        F.lit(0).alias("seq"),
    )


def replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reruns of finished orders with an even key: the tree ranking, then for every third the cooperation one.

    A rerun under an unknown scenario has no baseline row.
    """
    rows = predictions(spark, sf_dir).filter((F.col("status") == "F") & (F.col("case_idx") % 2 == 0))
    first = rows.filter(F.col("method") == "tree").withColumn("seq", F.lit(1))
    second = rows.filter((F.col("method") == "cooperation") & (F.col("case_idx") % 3 == 0)).withColumn("seq", F.lit(2))
    both = first.unionByName(second).withColumn(
        "scenario", F.when(F.col("case_idx") % 11 == 0, "unknown").otherwise(F.col("scenario"))
    )
    marked = repair.mark_rerun(both)
    return marked.select(
        F.lit("competition").alias("method"), "scenario", F.col("scenario").alias("alarm_type"), "case_idx", "pred_rc", "parse_strategy", "seq"
    )


SQL_BASELINE = SQL_PREDICTIONS + """,
baseline AS (
  SELECT method, scenario, case_idx, CASE WHEN status = 'F' THEN '' ELSE pred END AS pred,
         CASE WHEN status = 'F' THEN 'unparsed' ELSE parse_strategy END AS parse_strategy
  FROM preds WHERE method = 'competition'),
offered AS (
  SELECT CASE WHEN case_idx % 11 = 0 THEN 'unknown' ELSE scenario END AS scenario, case_idx, pred,
         'rerun:' || parse_strategy AS parse_strategy, CASE WHEN method = 'tree' THEN 1 ELSE 2 END AS seq
  FROM preds WHERE status = 'F' AND case_idx % 2 = 0 AND (method = 'tree' OR (method = 'cooperation' AND case_idx % 3 = 0))),
latest AS (SELECT * FROM offered QUALIFY row_number() OVER (PARTITION BY scenario, case_idx ORDER BY seq DESC) = 1),
merged AS (
  SELECT b.method, b.scenario, b.case_idx, CASE WHEN l.case_idx IS NULL THEN b.pred ELSE l.pred END AS pred,
         CASE WHEN l.case_idx IS NULL THEN b.parse_strategy ELSE l.parse_strategy END AS parse_strategy,
         l.case_idx IS NOT NULL AS rerun
  FROM baseline b LEFT JOIN latest l ON l.scenario = b.scenario AND l.case_idx = b.case_idx)"""


@registry.add(f"""WITH {SQL_BASELINE}
SELECT scenario, case_idx, parse_strategy FROM baseline
WHERE pred = '' OR parse_strategy LIKE '%candidate_text_fallback%'""")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = repair.failed_cases(baseline(spark, sf_dir), include_text_fallback=True)
    return failed.select("scenario", "case_idx", "parse_strategy")


@registry.add(f"""WITH {SQL_BASELINE},
numbered AS (
  SELECT scenario, case_idx, (row_number() OVER (PARTITION BY scenario ORDER BY case_idx) - 1) // 16 AS batch
  FROM baseline WHERE pred = '')
SELECT scenario, scenario AS alarm_type, batch, string_agg(case_idx::VARCHAR, '|' ORDER BY case_idx) AS indices
FROM numbered GROUP BY 1, 2, 3""")
def rerun_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = repair.rerun_plan(repair.failed_cases(baseline(spark, sf_dir)))
    return plan.select("scenario", "alarm_type", "batch", joined(F.col("indices").cast("array<string>"), "indices"))


@registry.add(f"""WITH {SQL_BASELINE},
rows_ AS (
  SELECT CASE WHEN case_idx % 17 = 2 THEN NULL ELSE scenario END AS scenario,
         CASE WHEN case_idx % 13 = 1 THEN NULL WHEN case_idx % 5 = 0 THEN case_idx // 50 ELSE case_idx END AS idx FROM baseline WHERE pred = ''),
numbered AS (SELECT *, row_number() OVER (PARTITION BY scenario, idx ORDER BY idx) AS turn FROM rows_)
SELECT scenario, count(*) AS failed, count(*) FILTER (idx IS NOT NULL AND scenario IS NOT NULL AND turn = 1) AS planned,
       count(*) FILTER (idx IS NULL) AS no_index, count(*) FILTER (idx IS NOT NULL AND scenario IS NULL) AS no_group,
       count(*) FILTER (idx IS NOT NULL AND scenario IS NOT NULL AND turn > 1) AS repeated_index, true AS complete FROM numbered GROUP BY 1""")
def rerun_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows, some without index or scenario and some under one index: all are planned or a problem with a reason."""
    idx = F.expr("CASE WHEN case_idx % 13 = 1 THEN NULL WHEN case_idx % 5 = 0 THEN case_idx div 50 ELSE case_idx END")
    scenario = F.when(F.col("case_idx") % 17 != 2, F.col("scenario"))
    failed = repair.failed_cases(baseline(spark, sf_dir)).withColumns({"scenario": scenario, "alarm_type": scenario, "case_idx": idx})
    plan, bad = repair.checked_reruns(failed)
    planned = plan.groupBy("scenario").agg(F.sum(F.size("indices")).alias("planned"))
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in (problems.NO_INDEX, problems.NO_GROUP, problems.REPEATED)]
    counted = bad.groupBy("scenario").agg(*reasons, F.count(F.lit(1)).alias("_bad"))
    total = failed.groupBy("scenario").agg(F.count(F.lit(1)).alias("failed"))
    joined_ = same_key_join(same_key_join(total, planned, ["scenario"], "left"), counted, ["scenario"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined_.select(
        "scenario", "failed", zero("planned"), *[zero(r) for r in (problems.NO_INDEX, problems.NO_GROUP, problems.REPEATED)],
        problems.accounted(F.col("failed"), F.col("planned"), F.col("_bad")).alias("complete"),
    )


@registry.add(f"""WITH {SQL_BASELINE}
SELECT scenario, case_idx, pred AS pred_rc, parse_strategy, rerun FROM merged""")
def merged_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = repair.merge_reruns(baseline(spark, sf_dir), replacements(spark, sf_dir))
    return merged.select("scenario", "case_idx", joined(F.col("pred_rc"), "pred_rc"), "parse_strategy", "rerun")


@registry.add(f"""WITH {SQL_BASELINE}
SELECT 'competition' AS method, (SELECT count(*) FROM merged) AS processed_count,
       (SELECT count(*) FROM baseline WHERE pred = '') AS requested_count, (SELECT count(*) FROM latest) AS rerun_count,
       (SELECT count(*) FROM latest WHERE pred <> '') AS rerun_parsed_count,
       (SELECT count(*) FROM latest WHERE pred = '') AS rerun_unparsed_count,
       (SELECT count(*) FROM merged WHERE pred = '') AS final_unparsed_count""")
def rerun_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = baseline(spark, sf_dir), replacements(spark, sf_dir)
    latest = new.groupBy("method", "scenario", "case_idx").agg(F.max_by("pred_rc", "seq").alias("pred_rc"))
    merged = repair.merge_reruns(base, new)
    return repair.rerun_counters(repair.failed_cases(base), latest, merged)


# --- feedback ---------------------------------------------------------------------------------
@registry.add(f"""WITH {SQL_PREDICTIONS},
judged AS (
  SELECT method, scenario, case_idx, coalesce(rank = 1, false) AS is_correct FROM preds WHERE groundtruth <> ''),
placed_cases AS (
  SELECT *, row_number() OVER (PARTITION BY method, scenario, is_correct ORDER BY case_idx) AS feedback_pos FROM judged)
SELECT method, scenario, case_idx, is_correct, feedback_pos::INT AS feedback_pos FROM placed_cases
WHERE feedback_pos <= CASE WHEN is_correct THEN 2 ELSE 8 END""")
def feedback_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = evaluate.rank_predictions(predictions(spark, sf_dir)).filter(F.col("groundtruth") != "")
    chosen = selection.feedback_cases(ranked, keys=("method", "scenario"))
    return chosen.select("method", "scenario", "case_idx", "is_correct", "feedback_pos")
