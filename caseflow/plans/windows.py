"""Incremental selection on events: scenario = event type, idx = event id (with gaps), ok = value > 0.05."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import incremental as inc
from caseflow.plans.common import Registry, table

registry = Registry()


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scenario"), F.col("event_id").alias("idx"), (F.col("value") > 0.05).alias("ok")
    )


def checkpoint_rows(spark: SparkSession, sf_dir: str, mode: str, day: str) -> DataFrame:
    """Checkpoints as of a day; signups have none yet."""
    seen = table(spark, sf_dir, "events").filter((F.col("ts") < F.lit(day).cast("timestamp")) & (F.col("event_type") != "signup"))
    return seen.groupBy(F.col("event_type").alias("folder")).agg(
        F.max("event_id").alias("last_index"), F.max("ts").alias("updated_at")
    ).select("folder", F.lit(mode).alias("mode"), F.col("folder").alias("alarm_type"), "last_index", "updated_at")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = checkpoint_rows(spark, sf_dir, "tree_infer", "2024-01-08")
    return tree.unionByName(checkpoint_rows(spark, sf_dir, "llm_infer", "2024-01-04"))


SQL_CASES = """
cases AS (SELECT event_type AS scenario, event_id AS idx, value > 0.05 AS ok FROM events),
marks AS (
  SELECT event_type AS scenario, max(event_id) FILTER (ts < TIMESTAMP '2024-01-08') AS last_tree,
         max(event_id) FILTER (ts < TIMESTAMP '2024-01-04') AS last_llm
  FROM events WHERE event_type <> 'signup' GROUP BY 1),
fresh AS (
  SELECT cases.*, coalesce(last_tree, -1) AS previous_last_index FROM cases LEFT JOIN marks USING (scenario)
  WHERE idx > coalesce(last_tree, -1))"""


@registry.add(f"WITH {SQL_CASES} SELECT scenario, idx, previous_last_index FROM fresh")
def new_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = inc.select_new(cases(spark, sf_dir), checkpoints(spark, sf_dir), "tree_infer")
    return chosen.select("scenario", "idx", "previous_last_index")


@registry.add(f"""WITH {SQL_CASES}
SELECT scenario, idx, previous_last_index FROM fresh
QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY idx) <= 150""")
def capped_new_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = inc.select_new(cases(spark, sf_dir), checkpoints(spark, sf_dir), "tree_infer", max_new=150)
    return chosen.select("scenario", "idx", "previous_last_index")


def last_index(spark: SparkSession, sf_dir: str) -> int:
    return cases(spark, sf_dir).agg(F.max("idx")).first()[0] or 0


@registry.add("""SELECT event_type AS scenario, event_id AS idx FROM events WHERE event_id >= (SELECT max(event_id) // 40 FROM events) AND event_id < (SELECT max(event_id) * 7 // 10 FROM events)""")
def manual_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, last = cases(spark, sf_dir), last_index(spark, sf_dir)
    return inc.select_window(rows, last // 40, last * 7 // 10).select("scenario", "idx")


@registry.add("""SELECT event_type AS scenario, min(event_id) AS window_start, (SELECT max(event_id) * 7 // 10 FROM events)::BIGINT AS window_end,
       count(*) FILTER (event_id < (SELECT max(event_id) * 7 // 10 FROM events)) AS selected_count, min(event_id) - 1 AS previous_last_index
FROM events GROUP BY 1""")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.window_plan(cases(spark, sf_dir), end=last_index(spark, sf_dir) * 7 // 10)


@registry.add(f"""WITH {SQL_CASES},
fails AS (SELECT scenario, min(idx) AS first_failed FROM fresh WHERE NOT ok GROUP BY 1)
SELECT f.scenario, max(f.previous_last_index) AS previous_last_index,
       coalesce(max(f.idx) FILTER (first_failed IS NULL OR f.idx < first_failed), max(f.previous_last_index)) AS last_index,
       max(first_failed) AS first_failed
FROM fresh f LEFT JOIN fails USING (scenario) GROUP BY 1""")
def advance_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = inc.select_new(cases(spark, sf_dir), checkpoints(spark, sf_dir), "tree_infer")
    previous = chosen.groupBy("scenario").agg(F.max("previous_last_index").alias("previous_last_index"))
    return inc.advance(chosen, previous)


@registry.add("""WITH both_ AS (
  SELECT event_type AS folder, 'tree_infer' AS mode, max(event_id) AS last_index FROM events
  WHERE ts < TIMESTAMP '2024-01-12' AND event_type <> 'signup' GROUP BY 1
  UNION ALL SELECT event_type, 'llm_infer', max(event_id) FROM events
  WHERE ts < TIMESTAMP '2024-01-04' AND event_type <> 'signup' GROUP BY 1)
SELECT folder, mode, folder AS alarm_type, last_index FROM both_""")
def updated_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    newer = checkpoint_rows(spark, sf_dir, "tree_infer", "2024-01-12")
    return inc.upsert_checkpoints(checkpoints(spark, sf_dir), newer).select("folder", "mode", "alarm_type", "last_index")


@registry.add("""WITH numbered AS (
  SELECT event_type AS scenario, event_id AS idx, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 16 AS batch
  FROM events)
SELECT scenario, batch, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM numbered GROUP BY 1, 2""")
def case_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.with_batch(cases(spark, sf_dir), 16).groupBy("scenario", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@registry.add("""WITH numbered AS (
  SELECT event_type AS scenario, event_id AS idx, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS block
  FROM events WHERE event_id < (SELECT max(event_id) * 6 // 10 FROM events))
SELECT scenario, idx, block FROM numbered""")
def case_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.with_block(cases(spark, sf_dir), last_index(spark, sf_dir) * 6 // 10, 50).select("scenario", "idx", "block")


@registry.add("""SELECT event_type AS scenario, event_id AS idx FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 75""")
def last_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.last_cases(cases(spark, sf_dir), 75).select("scenario", "idx")


@registry.add(f"""WITH {SQL_CASES},
bounds AS (SELECT scenario, min(idx) AS first_infer FROM fresh GROUP BY 1)
SELECT c.scenario, c.idx, least(count(*) OVER (PARTITION BY c.scenario), 50) AS train_available
FROM cases c JOIN bounds b ON b.scenario = c.scenario AND c.idx < b.first_infer
QUALIFY row_number() OVER (PARTITION BY c.scenario ORDER BY c.idx DESC) <= 50""")
def train_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cases = cases(spark, sf_dir)
    infer = inc.select_new(all_cases, checkpoints(spark, sf_dir), "tree_infer")
    return inc.trailing_train_window(all_cases, infer).select("scenario", "idx", "train_available")


@registry.add("""WITH numbered AS (
  SELECT event_type AS scenario, event_id AS idx, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS block,
         count(*) OVER (PARTITION BY event_type) AS n FROM events),
blocks AS (
  SELECT scenario, block, min(idx) AS infer_first_idx, max(idx) AS infer_last_idx, count(*) AS infer_n, max(n) AS n
  FROM numbered GROUP BY 1, 2)
SELECT b.scenario, b.block::INT AS stage, b.block * 50 AS train_n, p.infer_last_idx AS train_last_idx, b.infer_n,
       b.infer_first_idx, b.infer_last_idx
FROM blocks b JOIN blocks p ON p.scenario = b.scenario AND p.block = b.block - 1 WHERE b.n >= 100""")
def tree_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.stage_specs(cases(spark, sf_dir), 50)


@registry.add("""WITH numbered AS (
  SELECT event_type AS scenario, event_id AS idx, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 AS block
  FROM events),
stages AS (SELECT DISTINCT scenario, block AS stage FROM numbered WHERE block > 0)
SELECT s.scenario, s.stage::INT AS stage, CASE WHEN n.block = s.stage THEN 'infer' ELSE 'train' END AS part, count(*) AS n,
       min(idx) AS first_idx, max(idx) AS last_idx
FROM stages s JOIN numbered n ON n.scenario = s.scenario AND n.block <= s.stage
WHERE s.scenario IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 1000) GROUP BY 1, 2, 3""")
def stage_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.stage_summary(cases(spark, sf_dir), 500)


@registry.add("""SELECT event_type AS scenario, count(*) FILTER (event_id BETWEEN 51 AND (SELECT max(event_id) // 2 FROM events)) AS case_count,
       count(*) FILTER (event_id BETWEEN 51 AND (SELECT max(event_id) // 2 FROM events)) = 1000 AS as_expected FROM events GROUP BY 1""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.window_counts(cases(spark, sf_dir), 51, last_index(spark, sf_dir) // 2, 1000)


@registry.add("""WITH wanted AS (
  SELECT scenario, idx FROM (SELECT DISTINCT event_type AS scenario FROM events),
       (SELECT unnest(range(51, (SELECT max(event_id) FROM events) + 101)) AS idx))
SELECT scenario, idx FROM wanted
EXCEPT SELECT event_type, event_id FROM events""")
def missing_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    return inc.missing_indices(rows, 51, last_index(spark, sf_dir) + 100)


@registry.add("""WITH ordered AS (
  SELECT event_type AS scenario, event_id AS idx, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before
  FROM events WHERE event_id >= 51),
gaps AS (
  SELECT scenario, coalesce(before + 1, 51) AS gap_start, idx - 1 AS gap_end FROM ordered
  UNION ALL SELECT scenario, max(idx) + 1, (SELECT max(event_id) + 100 FROM events) FROM ordered GROUP BY 1)
SELECT scenario, gap_start, gap_end FROM gaps WHERE gap_start <= gap_end""")
def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.gap_ranges(cases(spark, sf_dir), 51, last_index(spark, sf_dir) + 100)
