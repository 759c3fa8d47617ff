"""Trees on order lines: one tree per line status, class = return flag, four numeric features."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.operators import features as feat
from caseflow.operators import binned, flow, refine, selection, tree
from caseflow.operators import incremental as inc
from caseflow.plans import documents, windows
from caseflow.plans.common import Registry, r6, table
from caseflow.scale import materialize, spread

registry = Registry()

KEYS = ["status"]
NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_returnflag", *NAMES)
    return spread(lines).select(
        F.col("l_linestatus").alias("status"),
        "l_orderkey",
        F.array(*[F.col(n).cast("double") for n in NAMES]).alias("features"),
        F.col("l_returnflag").alias("root_cause"),
    )


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).withColumn("label", F.col("root_cause"))


def _sql_level(source: str, name: str, names: list[str] = NAMES) -> str:
    """Best split per (status, node) over `source` (status, node, f0 .. f3, label), by sorted running counts."""
    long = " UNION ALL ".join(f"SELECT status, node, {i} AS feature, f{i} AS value, label FROM {source}" for i in range(len(names)))
    running = ", ".join(
        f"sum(count(*) FILTER (label = '{c}')) OVER (PARTITION BY status, node, feature ORDER BY value) AS l{c}" for c in "ANR"
    )
    totals = ", ".join(f"max(l{c}) OVER g - l{c} AS r{c}" for c in "ANR")
    left, right = "+".join(f"l{c}" for c in "ANR"), "+".join(f"r{c}" for c in "ANR")
    left2, right2 = ("+".join(f"{side}{c}::DOUBLE*{side}{c}" for c in "ANR") for side in "lr")
    return f"""
{name}_long AS ({long}),
{name}_run AS (SELECT status, node, feature, value, {running} FROM {name}_long GROUP BY status, node, feature, value),
{name}_both AS (
  SELECT *, lead(value) OVER (PARTITION BY status, node, feature ORDER BY value) AS next_value, {totals}
  FROM {name}_run WINDOW g AS (PARTITION BY status, node, feature)),
{name} AS (
  SELECT status, node, feature, (value + next_value) / 2 AS threshold FROM {name}_both
  WHERE next_value IS NOT NULL AND ({left}) >= 10 AND ({right}) >= 10
  QUALIFY row_number() OVER (PARTITION BY status, node
    ORDER BY ({left2}) / ({left}) + ({right2}) / ({right}) DESC, feature, value) = 1)"""


def _sql_base(names: list[str] = NAMES) -> str:
    values = ", ".join(f"{n}::FLOAT::DOUBLE AS f{i}" for i, n in enumerate(names))
    return f"base AS (SELECT l_linestatus AS status, l_orderkey, 1 AS node, {values}, l_returnflag AS label FROM lineitem)"


SQL_BASE = _sql_base()


def _sql_move(source: str, splits: str, name: str, names: list[str] = NAMES) -> str:
    value = "CASE s.feature " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(names))) + " END"
    columns = ", ".join(f"f{i}" for i in range(len(names)))
    return f"""
{name} AS (
  SELECT b.status, b.l_orderkey, CASE WHEN s.node IS NULL THEN b.node WHEN {value} <= s.threshold THEN b.node * 2 ELSE b.node * 2 + 1 END AS node,
         {columns}, label FROM {source} b LEFT JOIN {splits} s ON s.status = b.status AND s.node = b.node)"""


def _sql_two(names: list[str] = NAMES) -> str:
    levels = [_sql_level("base", "s1", names), _sql_move("base", "s1", "one", names), _sql_level("one", "s2", names), _sql_move("one", "s2", "two", names)]
    return ", ".join([_sql_base(names), *levels])


SQL_TWO = _sql_two()


@registry.add(f"WITH {SQL_BASE}, {_sql_level('base', 's1')} SELECT status, node::BIGINT AS node, feature, round(threshold, 6) AS threshold FROM s1")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root split of every tree."""
    train = train_rows(spark, sf_dir).withColumn("node", F.lit(1).cast("bigint"))
    found = tree.best_splits(tree.value_counts(train, KEYS), tree.class_counts(train, KEYS), KEYS, 10)
    return found.select("status", "node", "feature", r6(F.col("threshold"), "threshold"))


@registry.add(f"""WITH {SQL_TWO},
leaves AS (SELECT status, node, label, count(*) AS n FROM two GROUP BY 1, 2, 3),
grid AS (SELECT * FROM (SELECT DISTINCT status, node FROM two) JOIN (SELECT DISTINCT status, label FROM base) USING (status)),
lists AS (
  SELECT status, node, string_agg(label || ':' || coalesce(n, 0), '|' ORDER BY coalesce(n, 0) DESC, label) AS dist, sum(coalesce(n, 0)) AS n
  FROM grid LEFT JOIN leaves USING (status, node, label) GROUP BY 1, 2)
SELECT status, node::BIGINT AS leaf, n::BIGINT AS n, dist FROM lists""")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of depth-2 trees with their class counts."""
    nodes = tree.fit(train_rows(spark, sf_dir), KEYS, max_depth=2)
    dist = F.transform("dist", lambda d: F.concat_ws(":", d["label"], d["n"].cast("string")))
    return tree.rules(nodes, KEYS, NAMES).select("status", "leaf", "n", F.array_join(dist, "|").alias("dist"))


SQL_NAME = "CASE {s}.feature " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"


@registry.add(f"""WITH {SQL_TWO},
leaves AS (SELECT status, node, label, count(*) AS n FROM two GROUP BY 1, 2, 3),
top AS (SELECT status, node, sum(n) OVER (PARTITION BY status, node) AS total, label FROM leaves
        QUALIFY row_number() OVER (PARTITION BY status, node ORDER BY n DESC, label) = 1),
ids AS (SELECT status, label, row_number() OVER (PARTITION BY status ORDER BY label) - 1 AS class_id FROM (SELECT DISTINCT status, label FROM base)),
told AS (
  SELECT t.status, t.node, t.label, total, CASE WHEN a.node IS NULL OR t.node = 1 THEN '(root leaf)' ELSE
      {SQL_NAME.format(s="a")} || CASE WHEN CASE WHEN t.node > 3 THEN t.node // 2 ELSE t.node END = 2 THEN ' <= ' ELSE ' > ' END || printf('%.2f', a.threshold)
      || CASE WHEN t.node > 3 THEN ' -> ' || {SQL_NAME.format(s="b")} || CASE WHEN t.node % 2 = 0 THEN ' <= ' ELSE ' > ' END || printf('%.2f', b.threshold) ELSE '' END END AS path
  FROM top t LEFT JOIN s1 a ON a.status = t.status LEFT JOIN s2 b ON b.status = t.status AND b.node = t.node // 2)
SELECT told.status, told.node::BIGINT AS leaf, path, told.label AS root_cause, class_id::INT AS class_id, total::BIGINT AS n
FROM told JOIN ids ON ids.status = told.status AND ids.label = told.label""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of depth-2 trees: the path of every leaf as text, its class and the class number of the mapping."""
    nodes = tree.fit(train_rows(spark, sf_dir), KEYS, max_depth=2)
    rules = tree.rules(nodes, KEYS, NAMES).select("status", "leaf", "path", "root_cause", "n")
    return rules.join(tree.class_mapping(nodes, KEYS), ["status", "root_cause"]).select("status", "leaf", "path", "root_cause", "class_id", "n")


@registry.add(f"""WITH {SQL_TWO},
leaves AS (SELECT status, node, label, count(*) AS n FROM two GROUP BY 1, 2, 3),
grid AS (SELECT * FROM (SELECT DISTINCT status, node FROM two) JOIN (SELECT DISTINCT status, label FROM base) USING (status)),
ranked AS (
  SELECT status, node, label, row_number() OVER (PARTITION BY status, node ORDER BY coalesce(n, 0) DESC, label) AS pos
  FROM grid LEFT JOIN leaves USING (status, node, label))
SELECT t.status, t.node::BIGINT AS leaf, r.pos::INT AS rank, count(*) AS n, count(*) FILTER (pos = 1) AS correct
FROM two t JOIN ranked r ON r.status = t.status AND r.node = t.node AND r.label = t.label GROUP BY 1, 2, 3""")
def tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth ranks of all lines under depth-2 trees, counted per leaf."""
    data = rows(spark, sf_dir)
    predicted, _nodes = tree.run(data, data, KEYS, NAMES, max_depth=2)
    return predicted.groupBy("status", "leaf", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))


@registry.add(f"""WITH {SQL_TWO},
top1 AS (SELECT status, node, label FROM (SELECT status, node, label, count(*) AS n FROM one GROUP BY 1, 2, 3)
         QUALIFY row_number() OVER (PARTITION BY status, node ORDER BY n DESC, label) = 1),
top2 AS (SELECT status, node, label FROM (SELECT status, node, label, count(*) AS n FROM two GROUP BY 1, 2, 3)
         QUALIFY row_number() OVER (PARTITION BY status, node ORDER BY n DESC, label) = 1),
scored AS (
  SELECT o.status, 1 AS depth, avg((o.label = t.label)::INT) AS accuracy FROM one o JOIN top1 t ON t.status = o.status AND t.node = o.node GROUP BY 1
  UNION ALL
  SELECT o.status, 2, avg((o.label = t.label)::INT) FROM two o JOIN top2 t ON t.status = o.status AND t.node = o.node GROUP BY 1)
SELECT status, depth AS selected_max_depth, round(accuracy, 6) AS selected_accuracy, 'infer_cases' AS validation_source FROM scored
QUALIFY row_number() OVER (PARTITION BY status ORDER BY accuracy DESC, depth DESC) = 1""")
def depth_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by validation among 2 and 1, the first one winning ties."""
    nodes = tree.fit(train_rows(spark, sf_dir), KEYS, max_depth=2)
    chosen = tree.choose_depth(tree.depth_scores(rows(spark, sf_dir), nodes, KEYS, (2, 1)), KEYS)
    return chosen.withColumn("selected_accuracy", F.round("selected_accuracy", 6))


# --- binned trees: fewer bins than values would be approximate, here every value has its own -----------
FEW_VALUED = ["l_quantity", "l_discount", "l_tax"]


@registry.add(f"""WITH {_sql_two(FEW_VALUED)},
classes AS (SELECT status, node, label, count(*) AS n FROM base GROUP BY 1, 2, 3 UNION SELECT status, node, label, count(*) FROM one GROUP BY 1, 2, 3
            UNION SELECT status, node, label, count(*) FROM two GROUP BY 1, 2, 3),
splits AS (SELECT * FROM s1 UNION SELECT s2.* FROM s2 JOIN (SELECT DISTINCT status, node FROM one WHERE node > 1) USING (status, node))
SELECT status, c.node::BIGINT AS node, feature, round(threshold, 6) AS threshold, n::BIGINT AS n, dist
FROM (SELECT status, node, sum(n) AS n, string_agg(label || ':' || n, '|' ORDER BY n DESC, label) AS dist FROM classes GROUP BY 1, 2) c
LEFT JOIN splits USING (status, node)""")
def binned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of binned trees of depth 2 over features with fewer values than bins: the exact splits."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", *FEW_VALUED))
    train = lines.select(
        F.col("l_linestatus").alias("status"), F.array(*[F.col(n).cast("double") for n in FEW_VALUED]).alias("features"), F.col("l_returnflag").alias("label")
    )
    seen = F.filter("dist", lambda d: d["n"] > 0)
    dist = F.transform(seen, lambda d: F.concat_ws(":", d["label"], d["n"].cast("string")))
    nodes = binned.fit(train, KEYS, bins=64, max_depth=2)
    return nodes.select("status", "node", "feature", r6(F.col("threshold"), "threshold"), "n", F.array_join(dist, "|").alias("dist"))


# --- documents to predictions -----------------------------------------------------------------
FLOW_TRAIN = 50


def _flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, sel["log"], sel["kpi"]) for s, sel in documents.SCENARIO_SELECTIONS.items()]
    selections = materialize(spark.createDataFrame(rows, "scenario string, log array<string>, kpi map<string,array<string>>"), "selections")
    found = flow.tree_flow(documents.cases(spark, sf_dir), selections, windows.checkpoints(spark, sf_dir), train_n=FLOW_TRAIN)
    marks = found.checkpoints.filter("mode = 'tree_infer'").select(F.col("folder").alias("scenario"), "last_index")
    return found.predictions.select("scenario", "idx", "leaf", "pred_top1_rc", "is_correct").join(marks, "scenario")


def _sql_flow_level(depth: int) -> str:
    """Best splits of the impure nodes on one level, and every case moved below them."""
    at, name, moved = f"at{depth}", f"best{depth}", f"at{depth + 1}"
    return f"""
open{depth} AS (
  SELECT scenario, node FROM {at} WHERE train AND node >= {2**depth} GROUP BY 1, 2 HAVING count(DISTINCT root) > 1 AND count(*) >= 20),
long{depth} AS (
  SELECT a.scenario, a.node, a.root, l.f, l.x FROM {at} a JOIN open{depth} USING (scenario, node)
  JOIN long l ON l.scenario = a.scenario AND l.idx = a.idx WHERE a.train),
steps{depth} AS (
  SELECT scenario, node, f, x, lead(x) OVER (PARTITION BY scenario, node, f ORDER BY x) AS next_x
  FROM (SELECT DISTINCT scenario, node, f, x FROM long{depth})),
sides{depth} AS (
  SELECT s.scenario, s.node, s.f, s.x, s.next_x, root, count(*) FILTER (l.x <= s.x) AS a, count(*) FILTER (l.x > s.x) AS b
  FROM steps{depth} s JOIN long{depth} l ON l.scenario = s.scenario AND l.node = s.node AND l.f = s.f WHERE next_x IS NOT NULL GROUP BY ALL),
{name} AS (
  SELECT scenario, node, f, (x + next_x) / 2 AS threshold FROM sides{depth}
  GROUP BY scenario, node, f, x, next_x HAVING sum(a) >= 10 AND sum(b) >= 10
  QUALIFY row_number() OVER (PARTITION BY scenario, node
    ORDER BY sum(a * a)::DOUBLE / sum(a) + sum(b * b)::DOUBLE / sum(b) DESC, f, x) = 1),
{moved} AS (
  SELECT c.scenario, c.idx, c.root, c.train, CASE WHEN b.f IS NULL THEN c.node WHEN l.x > b.threshold THEN c.node * 2 + 1 ELSE c.node * 2 END AS node
  FROM {at} c LEFT JOIN {name} b USING (scenario, node) LEFT JOIN long l ON l.scenario = c.scenario AND l.idx = c.idx AND l.f = b.f)"""


def _sql_flow_all() -> str:
    """Trees of three levels over the selected features and every new case; splits by comparing all values with all training rows."""
    sql, places = documents._sql_features(), {rule[0]: i for i, rule in enumerate(feat.feature_rules())}
    arms = []
    for scenario, selection in documents.SCENARIO_SELECTIONS.items():
        pairs = ", ".join(f"{{'f': {places[n]}, 'x': ({sql[n]})::FLOAT::DOUBLE}}" for n in documents._selected_names(selection))
        arms.append(f"SELECT scenario, e AS idx, unnest([{pairs}]) AS p FROM chosen WHERE scenario = '{scenario}'")
    return f"""WITH {documents.SQL_EVENTS}, {windows.SQL_CASES},
rooted AS (SELECT *, {documents.SQL_ROOT} AS root FROM ev),
new_ AS (SELECT r.* FROM rooted r JOIN fresh f ON f.scenario = r.scenario AND f.idx = r.e),
train_ AS (
  SELECT r.* FROM rooted r JOIN (SELECT scenario, min(e) AS first_e FROM new_ GROUP BY 1) b ON b.scenario = r.scenario AND r.e < b.first_e
  WHERE root <> '' QUALIFY row_number() OVER (PARTITION BY r.scenario ORDER BY e DESC) <= {FLOW_TRAIN}),
chosen AS (SELECT *, true AS train FROM train_ UNION ALL SELECT *, false FROM new_),
long AS (SELECT scenario, idx, p.f AS f, p.x AS x FROM ({" UNION ALL ".join(arms)})),
at0 AS (SELECT scenario, e AS idx, root, train, 1 AS node FROM chosen),
{", ".join(_sql_flow_level(d) for d in range(vocab.MAX_DEPTH))},
top AS (
  SELECT scenario, node, root AS best_root FROM at{vocab.MAX_DEPTH} WHERE train GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY scenario, node ORDER BY count(*) DESC, root) = 1)
SELECT p.scenario, p.idx, node::BIGINT AS leaf, best_root AS pred_top1_rc, CASE WHEN root <> '' THEN root = best_root END AS is_correct,
       max(p.idx) OVER (PARTITION BY p.scenario) AS last_index
FROM at{vocab.MAX_DEPTH} p JOIN top USING (scenario, node) WHERE NOT train"""


@registry.add(_sql_flow_all())
def tree_flow_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections, train window, features, trees, predictions and checkpoints from event documents, for every new case.

    Signups have no checkpoint, so no earlier case to learn from: they stay without predictions and without a mark.
    """
    return _flow_rows(spark, sf_dir)


# --- selections refined by answers ------------------------------------------------------------
REFINE_ROUNDS = 3
REFINE_OPTIONS = (documents.SCENARIO_SELECTIONS["click"], documents.SCENARIO_SELECTIONS["error"])
REFINE_TYPES = ("click", "error", "purchase", "signup", "view")


def _completed(chosen: dict) -> dict:
    """A selection with the default tokens that normalising adds to every KPI."""
    def tokens(given: list[str]) -> list[str]:
        add = [default for default, allowed in (("mix", vocab.SEGMENT_TOKENS), ("mean", vocab.STAT_TOKENS)) if not set(given) & set(allowed)]
        return given + add

    return {"log": chosen["log"], "kpi": {k: tokens(chosen["kpi"].get(k, [])) for k in vocab.KPIS}}


def _sql_refine() -> str:
    sql, places = documents._sql_features(), {rule[0]: i for i, rule in enumerate(feat.feature_rules())}
    arms = []
    for option, chosen in enumerate(REFINE_OPTIONS):
        pairs = ", ".join(f"{{'f': {places[n]}, 'x': ({sql[n]})::FLOAT::DOUBLE}}" for n in documents._selected_names(_completed(chosen)))
        arms.append(f"SELECT {option} AS opt, scenario, e AS idx, root, train, unnest([{pairs}]) AS p FROM chosen")
    types = ", ".join(f"'{t}'" for t in REFINE_TYPES)
    states = ["state0 AS (SELECT DISTINCT scenario, 0 AS opt FROM chosen)"]
    for r in range(1, REFINE_ROUNDS):
        states.append(f"state{r} AS (SELECT s.scenario, coalesce(p.opt, s.opt) AS opt FROM state{r - 1} s LEFT JOIN picked p ON p.scenario = s.scenario AND p.round = {r - 1})")
    rounds_ = " UNION ALL ".join(f"SELECT {r} AS round, scenario, opt FROM state{r}" for r in range(REFINE_ROUNDS))
    logs = " ".join(f"WHEN {i} THEN '{'|'.join(o['log'])}'" for i, o in enumerate(REFINE_OPTIONS))
    return f"""WITH {documents.SQL_EVENTS},
rooted AS (SELECT *, {documents.SQL_ROOT} AS root, (SELECT max(e) // 2 FROM ev) AS mid FROM ev),
train_ AS (SELECT * FROM rooted WHERE e < mid AND root <> '' QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY e DESC) <= {FLOW_TRAIN}),
chosen AS (SELECT *, true AS train FROM train_ UNION ALL SELECT *, false FROM rooted WHERE e >= mid),
long AS (SELECT opt, scenario, idx, root, train, p.f AS f, p.x AS x FROM ({" UNION ALL ".join(arms)})),
steps AS (SELECT opt, scenario, f, x, lead(x) OVER (PARTITION BY opt, scenario, f ORDER BY x) AS next_x FROM (SELECT DISTINCT opt, scenario, f, x FROM long WHERE train)),
sides AS (
  SELECT s.opt, s.scenario, s.f, s.x, s.next_x, root, count(*) FILTER (l.x <= s.x) AS a, count(*) FILTER (l.x > s.x) AS b
  FROM steps s JOIN long l ON l.opt = s.opt AND l.scenario = s.scenario AND l.f = s.f AND l.train WHERE next_x IS NOT NULL GROUP BY ALL),
best AS (
  SELECT opt, scenario, f, (x + next_x) / 2 AS threshold FROM sides GROUP BY opt, scenario, f, x, next_x HAVING sum(a) >= 10 AND sum(b) >= 10
  QUALIFY row_number() OVER (PARTITION BY opt, scenario ORDER BY sum(a * a)::DOUBLE / sum(a) + sum(b * b)::DOUBLE / sum(b) DESC, f, x) = 1),
options AS (SELECT unnest(range({len(REFINE_OPTIONS)})) AS opt),
placed AS (
  SELECT o.opt, c.scenario, c.e AS idx, c.root, c.train, CASE WHEN b.f IS NULL THEN 1 WHEN l.x > b.threshold THEN 3 ELSE 2 END AS leaf
  FROM chosen c CROSS JOIN options o LEFT JOIN best b ON b.opt = o.opt AND b.scenario = c.scenario
  LEFT JOIN long l ON l.opt = o.opt AND l.scenario = c.scenario AND l.idx = c.e AND l.f = b.f),
top AS (
  SELECT opt, scenario, leaf, root AS best_root FROM placed WHERE train GROUP BY 1, 2, 3, 4
  QUALIFY row_number() OVER (PARTITION BY opt, scenario, leaf ORDER BY count(*) DESC, root) = 1),
judged AS (
  SELECT opt, scenario, count(*) FILTER (root <> '') AS labeled_total, count(*) FILTER (root <> '' AND root = best_root) AS correct
  FROM placed JOIN top USING (opt, scenario, leaf) WHERE NOT train GROUP BY 1, 2),
answers AS (
  SELECT [{types}][1 + conv_id % 5] AS scenario, turn % {REFINE_ROUNDS} AS round, conv_id * 100 + turn AS pos,
         CASE length(text) % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS opt
  FROM conversations WHERE role = 'assistant' AND conv_id % 7 = 3),
picked AS (SELECT scenario, round, opt FROM answers WHERE opt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scenario, round ORDER BY pos) = 1),
{", ".join(states)}
SELECT s.scenario, s.round::INT AS round, CASE s.opt {logs} END AS log, labeled_total, correct, p.opt IS NULL AS fell_back
FROM ({rounds_}) s LEFT JOIN judged j USING (opt, scenario) LEFT JOIN picked p ON p.scenario = s.scenario AND p.round = s.round"""


@registry.add(_sql_refine())
def selection_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three refining rounds: trees of one split, their summary, and the next selection from assistant turns.

    A turn belongs to a scenario and a round; what it selects follows from its length, and some turns select nothing.
    """
    cases = documents.cases(spark, sf_dir).select("scenario", "idx", "sem", "root_cause")
    middle = (table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) // 2
    # Written before it is filtered: the planner would push the filter below the dealing out, into the few tasks of the scan.
    plain = materialize(cases.select("scenario", "idx", "root_cause"), "plain")
    after = plain.filter(F.col("idx") >= middle)
    window = inc.trailing_train_window(plain.filter("root_cause <> ''"), after.select("scenario", "idx").unionByName(plain.select("scenario", F.lit(middle).cast("bigint").alias("idx"))), FLOW_TRAIN)
    train = cases.join(materialize(window.select("scenario", "idx"), "window"), ["scenario", "idx"], "left_semi")
    start = selection.normalise(F.parse_json(F.lit(json.dumps(REFINE_OPTIONS[0]))))
    first = plain.select("scenario").distinct().select("scenario", start.alias("selection"))
    texts = F.when(F.length("text") % 3 == 0, F.col("text"))
    for place, option in enumerate(REFINE_OPTIONS):
        texts = texts.when(F.length("text") % 3 == place + 1, F.concat(F.regexp_replace("text", "[{}`]", " "), F.lit(f"\n```json\n{json.dumps(option)}\n```")))
    types = F.array(*[F.lit(t) for t in REFINE_TYPES])
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND conv_id % 7 = 3").select(
        F.get(types, (F.col("conv_id") % 5).cast("int")).alias("scenario"), (F.col("turn") % REFINE_ROUNDS).cast("int").alias("round"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), texts.alias("text"),
    )
    found = refine.refine(
        train, cases.filter(F.col("idx") >= middle), first, lambda prompts: prompts.join(said, ["scenario", "round"]).select("scenario", "pos", "text"),
        "{alarm_type} {round}\n{previous_selection}\n{validcase_summary}", rounds=REFINE_ROUNDS, max_depth=1,
    )
    return found.state.select(
        "scenario", "round", F.array_join("selection.log", "|").alias("log"), "labeled_total", "correct", F.col("fallback_reason").isNotNull().alias("fell_back")
    )
