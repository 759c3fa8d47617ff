"""Near copies where one id stands on rows with different texts."""

from __future__ import annotations

import random

from caseflow.llm import ngram_join


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_different_texts_under_one_id_are_judged_apart(spark):
    a, b, c, d, e = map(prose, range(5))
    rows = [
        (1, a), (5, a), (5, b),  # 5 has a copy of 1 and a text of its own
        (6, c), (6, d), (6, d),  # two texts, one of them twice
        (8, e), (9, e + " tail"), (8, c), (9, prose(9)),  # the smaller id of every group stays
        (3, "!"), (3, prose(10)), (3, None), (None, a),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = [(1, a), (5, b), (6, c), (6, d), (8, e), (9, prose(9)), (3, "!"), (3, prose(10)), (3, None), (None, a)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
