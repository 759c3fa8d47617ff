import ast
import json
import random
import re

from pyspark.sql import functions as F

from caseflow.functions.ranking import all_rankings, best_ranking
from caseflow.operators import answers
from caseflow.plans import answers as answer_plans

TEXTS = [
    ('Answer: ["B","A"]', ["A", "B"], ["B", "A"], "structured_array"),
    ("Answer: ['B', 'A']", ["A", "B"], ["B", "A"], "structured_array"),
    ('x [{"category": "A"}, {"category": "B"}, {"name": "C"}]', ["A", "B", "C"], ["A", "B"], "structured_array"),
    ('["A"] and later ["B"]', ["A", "B"], ["B"], "structured_array"),
    ('["A", "B"] then ["B"]', ["A", "B"], ["A", "B"], "structured_array"),
    ('["A", ["B"], "C"]', ["A", "B", "C"], ["A", "C"], "structured_array"),
    ('["a [nested] one", "B"]', ["a [nested] one", "B"], ["a [nested] one", "B"], "structured_array"),
    ("no array, first B then A", ["A", "B"], ["B", "A"], "candidate_text_fallback"),
    ("A</think>only B here", ["A", "B"], ["B"], "candidate_text_fallback"),
    ("nothing [1, 2, 3]", ["A"], [], "unparsed"),
    ("“A” is in [“A”, “B”]", ["A", "B"], ["A", "B"], "structured_array"),
    ("['A', None, 'B', ...]", ["A", "B"], ["A", "B"], "structured_array"),
    (r"""['it\'s "A"', 'B' 'C', "D",]""", ["it's \"A\"", "BC", "D"], ["it's \"A\"", "BC", "D"], "structured_array"),
    (None, ["A"], [], "unparsed"),
]


def test_parse_policy(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _r, _s) in enumerate(TEXTS)], "i int, text string, candidates array<string>")
    got = {r.i: (r.pred_rc, r.parse_strategy) for r in answers.parse_answers(df).collect()}
    assert got == {i: (r, s) for i, (_t, _c, r, s) in enumerate(TEXTS)}


def slow_best(text, candidates):
    """Direct statement of the policy, for random texts."""
    found = []

    def add(value):
        if isinstance(value, list):
            names = []
            for v in value:
                name = v.strip() if isinstance(v, str) else str(v.get("category", "")).strip() if isinstance(v, dict) else None
                if name in candidates and name not in names:
                    names.append(name)
            if names and names not in found:
                found.append(names)

    for m in re.finditer(r"\[", text):
        try:
            add(json.JSONDecoder().raw_decode(text, m.start())[0])
        except ValueError:
            pass
    for block in re.findall(r"\[[^\[\]]*\]", text):
        try:
            add(ast.literal_eval(block))
        except (ValueError, SyntaxError):
            pass
    return max(enumerate(found), key=lambda p: (len(p[1]), p[0]))[1] if found else None


def test_random_texts(spark):
    rng = random.Random(3)
    pieces = ['["A"', '"B"', "'C'", "['A', 'B'", "]", ", ", "[", '{"category": "C"}', "7", "text ", '"A", "C"]', "['C', 'A']", "[]", '["B", ["A"]]']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t, ["A", "B", "C"]) for t in texts], "t string, c array<string>")
    got = {r.t: r.b for r in df.select("t", best_ranking(all_rankings(F.col("t"), F.col("c"))).alias("b")).collect()}
    wrong = {t: (got[t], slow_best(t, ["A", "B", "C"])) for t in texts if got[t] != slow_best(t, ["A", "B", "C"])}
    assert not wrong


def test_only_last_round_and_only_verifier(spark):
    cases = spark.createDataFrame([("s", 1, "A", ["A", "B"]), ("s", 2, "A", ["A", "B"]), ("s", 3, "B", ["A", "B"])], "scenario string, case_idx bigint, groundtruth string, candidates array<string>")
    said = spark.createDataFrame(
        [
            ("s", 1, "meta", 0, '["A","B"]'), ("s", 1, "meta", 1, "unclear"), ("s", 2, "meta", 0, '["A"]'), ("s", 2, "meta", 1, None),
            ("s", 3, "meta", 2, '["B"]'), ("s", 3, "reasoner", 9, '["A"]'), ("s", 1, "verifier", None, '["B","A"]'), ("s", 2, "competition", None, '["A"]'),
        ],
        "scenario string, case_idx bigint, role string, round int, text string",
    )
    coop = {r.case_idx: (r.pred_rc, r.parse_strategy, r.rank) for r in answers.method_results(cases, said, "cooperation").collect()}
    assert coop == {1: ([], "unparsed", None), 2: ([], "unparsed", None), 3: (["B"], "cooperation_meta:round2:structured_array", 1)}
    comp = {r.case_idx: (r.pred_rc, r.parse_strategy, r.rank) for r in answers.method_results(cases, said, "competition").collect()}
    assert comp == {1: (["B", "A"], "competition_reasoner:structured_array", 2), 2: ([], "unparsed", None), 3: ([], "unparsed", None)}


def test_unclosed_brackets_cost_their_own_piece(spark):
    import time

    def seconds(n):
        text = '["B", ["x"], "A"] ' + '["A", ' * n
        df = spark.createDataFrame([(text, ["A", "B"])], "text string, candidates array<string>")
        started = time.perf_counter()
        assert answers.parse_answers(df).first().pred_rc == ["B", "A"]
        return time.perf_counter() - started

    seconds(10)
    assert seconds(20_000) < 20 and seconds(40_000) < 40


def test_orders_are_ranked_once_for_all_that_reads_them(spark):
    """Cases, saved predictions and answers come from one written table, not from a ranking of their own each."""
    for query in (answer_plans.rescored_answers, answer_plans.reparsed_reruns, answer_plans.competition_results):
        files = query(spark, "/root/testdata/sf0.001").inputFiles()
        assert any("/responses/" in f for f in files) and not any("lineitem" in f for f in files)
