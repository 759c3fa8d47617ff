"""Pair-bound MaxScore against brute force, and on awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import oracle
import pytest

import __spark_entry__ as entry
from caseflow.llm import lexical

SF = "/root/testdata/sf0.001"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Scores of all documents in Python integers."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c and i is not None]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    found = {}
    for item, wanted in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, i))
        found[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return {i: f for i, f in found.items() if f}


def searched(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id bigint, text string, id string, term int, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, id int")
    rows = lexical.search(d, q, **more).collect()
    found = collections.defaultdict(dict)
    for r in rows:
        assert r["rank"] not in found[r["item_id"]]
        found[r["item_id"]][r["rank"]] = (r["doc_id"], r["score"])
    return {i: [ranks[k] for k in sorted(ranks)] for i, ranks in found.items()}


def corpus(seed, n, vocabulary=150):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"
    return [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("segment", [1 << 9, 1 << 12, 1 << 23])
def test_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment)
    docs = corpus(1, 600)
    items = [(100 + i, t) for i, (_, t) in enumerate(corpus(2, 40))]
    assert searched(spark, docs, items) == brute(docs, items)
    assert searched(spark, docs, items, k=3, block_terms=50) == brute(docs, items, 3)


def test_awkward_rows(spark):
    long = " ".join(t for _, t in corpus(5, 3000))
    docs = [(0, None), (1, ""), (2, " .,!"), (3, "One one ONE"), (4, "one"), (5, "one"), (6, "é É 日本 日本"), (None, "one two"), (7, long), (8, "w1 " * 20_000), (9, "x" * 300_000)]
    items = [(1, "one"), (1, "w3 w5"), (2, None), (3, ""), (None, "one"), (4, "É"), (5, "absent"), (6, "日本 one one"), (7, "x" * 300_000), (8, long)]
    assert searched(spark, docs, items) == brute(docs, items)
    assert searched(spark, docs, []) == {} and searched(spark, [], items) == {} and searched(spark, [(1, None)], items) == {}


def test_ties_and_repeats(spark):
    docs = [(i, "same words here") for i in range(50, 20, -1)] + [(99, "other")]
    found = searched(spark, docs, [(1, "words")])
    assert [d for d, _ in found[1]] == list(range(21, 31)) and found == brute(docs, [(1, "words")])
    twice = [(3, "a b"), (3, "a b"), (4, "c")]
    assert searched(spark, twice, [(1, "a")]) == {1: [(3, brute(twice, [(1, "a")])[1][0][1])] * 2}


def segment_of(docs, wanted):
    """A segment and its queries made without Spark, all weights by hand."""
    vocabulary = sorted({t for c in docs for t in c})
    number = {t: i for i, t in enumerate(vocabulary)}
    posts = [(number[t], d, n) for d, c in enumerate(docs) for t, n in c.items()]
    posts.sort()
    counts = collections.Counter(t for t, _, _ in posts)
    row = {
        "ids": np.arange(len(docs), dtype=np.int64).tobytes(),
        "lengths": np.array([sum(c.values()) for c in docs], np.int64).tobytes(),
        "vocabulary": np.arange(len(vocabulary), dtype=np.uint64).tobytes(),
        "counts": np.array([counts[i] for i in range(len(vocabulary))], np.int64).tobytes(),
        "ordinals": np.array([d for _, d, _ in posts], np.int32).tobytes(),
        "tf": np.array([n for _, _, n in posts], np.int64).tobytes(),
    }
    weights = np.array([1000 + 37 * i % 900 for i in range(len(vocabulary))], np.int64)
    queries = lexical.Queries([0], np.arange(len(vocabulary), dtype=np.uint64), weights, [np.array([number[t] for t in wanted])])
    return lexical.Segment(row, queries, len(docs), sum(sum(c.values()) for c in docs)), queries


def test_bounds_skip_without_losing():
    rng = random.Random(8)
    work: dict[str, int] = {}
    plain: dict[str, int] = {}
    for _ in range(60):
        docs = [collections.Counter(f"t{int(40 * rng.random() ** 2):02d}" for _ in range(rng.randrange(1, 12))) for _ in range(300)]
        wanted = sorted(rng.sample(sorted({t for c in docs for t in c}), 9))
        segment, queries = segment_of(docs, wanted)
        scores = np.zeros(len(docs), np.int64)
        for term in queries.members[0]:
            at, impacts = segment.postings(term)
            scores[at] += impacts
        expected = lexical.best(scores, segment.ids, 10)
        floor = int(expected[0][-1])
        got = lexical.pair_max_score(segment, queries.members[0], floor, 10, work)
        assert all((a == b).all() for a, b in zip(got, expected, strict=True))
        free = lexical.pair_max_score(segment, queries.members[0], 1, 10)
        assert all((a == b).all() for a, b in zip(free, expected, strict=True))
        # The same with bounds of single terms only: pairs must not score more documents.
        segment.pairs = {}
        segment.intersect = lambda a, b, s=segment: (int(s.top[a] + s.top[b]), np.union1d(s.postings(a)[0], s.postings(b)[0]))
        lexical.pair_max_score(segment, queries.members[0], floor, 10, plain)
    assert work["scored"] < work["all"] / 2 and work["scored"] <= plain["scored"]


def test_lengths_beyond_64_bits():
    lengths = np.array([3, 10**15, 7 * 10**16], np.int64)
    assert lexical._scaled(lengths, 10**9, 10**17).tolist() == [90 * n * 10**9 // 10**17 for n in lengths.tolist()]


def test_query_against_sql(spark):
    name = "op12_pair_bound_search"
    r = oracle.compare(spark, oracle.connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r["note"]
