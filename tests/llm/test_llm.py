"""Operators of the training-data subpackage against brute force, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import ann, components, decontaminate, filters, language, mixing, ngram_join, quality, secrets, sharding, substring, toxicity
from caseflow.llm import textblocks
from caseflow.llm.textblocks import ALNUM, LOWER, NOT_SPACE, SAME, blocks, rolling, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h int, shard string, _copy int, _score string, _spans int"


def rows_of(texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return [(i, t, "en", s, None, "x", 1, "y", 7, "z", 3) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed, n, vocabulary=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Null, empty, blank, short, equal, near, long and non-ASCII texts, a repeated row, null ids and sources."""
    base = prose(1, 120, 5000)
    near = base.split()
    near[60] = "changed"
    long = prose(2, 30_000, 9000)
    texts = [None, "", " \n\t", "One", "one", "two words", base, base, " ".join(near), base.upper(), long, long + " tail", "ééé ß Ω " * 30]
    texts += [prose(3, 40) + " " + base[:300], prose(4, 40) + " " + base[:300], "x" * 5000]
    rows = rows_of(texts, [None, "a", "a"] + ["b"] * (len(texts) - 3))
    return [*rows, rows[6], (None, base, None, None, None, "x", 1, "y", 7, "z", 3), (None, None, None, None, None, None, None, None, None, None, None)]


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- words and hashes -----------------------------------------------------------------------------------


def test_words_match_regular_expressions():
    texts = ["", None, "a b", " a\tbb\n", "É-x_9 ÿ", "A1b!!c", "z" * 400, "\x0b\x0c\x1cq"]
    for member, fold, pattern, prepare in (
        (NOT_SPACE, SAME, r"[^\x20\x09-\x0D]+", lambda t: t or ""),
        (ALNUM, LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered),
    ):
        for limit in (1, 7, 1 << 20):
            seen = []
            for block in blocks(pa.array(texts), limit):
                w = words(block, member, fold)
                for r in range(block.hi - block.lo):
                    own = slice(w.bounds[r], w.bounds[r + 1])
                    seen.append([bytes(fold[block.data[a:b]]).decode() for a, b in zip(w.start[own], w.end[own], strict=True)])
            assert seen == [re.findall(pattern, prepare(t)) for t in texts]


def test_hashes_differ_for_different_words():
    texts = [f"{a}{b}" for a in ("", "x" * 70, "ción") for b in range(3000)]
    found = set()
    for block in blocks(pa.array([" ".join(texts)])):
        found.update(words(block, NOT_SPACE, SAME).hashes.tolist())
    assert len(found) == len(set(texts))
    values = np.arange(50, dtype=np.uint64)
    assert len(set(rolling(values, 13).tolist())) == 38 and len(rolling(values, 51)) == 0


def test_hashes_do_not_depend_on_steps():
    data = np.frombuffer(" ".join(["ab", "x" * 1000, "c" * 63, "d" * 64, "é" * 400, "y"]).encode(), np.uint8)
    (block,) = blocks(pa.array([data.tobytes().decode()]))
    w = words(block, NOT_SPACE, SAME)
    for step in (1, 7, 64, 1001, 1 << 20):
        assert (textblocks._word_hashes(data, w.start, w.end, step) == w.hashes).all()


def test_filter_keeps_members(spark):
    members = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for bits in (1 << 16, 1 << 27):
        filled = filters.build(members, "h", bits)
        h = np.array([r["h"] for r in members.collect()])
        assert filters.passes(filled, h).all()
    others = np.array([r["h"] for r in spark.range(5000, 9000).select(F.xxhash64("id").alias("h")).collect()])
    assert filters.passes(filters.build(members, "h"), others).mean() < 0.05


def test_without_keeps_nulls_and_repeats(spark, awkward):
    docs = table(spark, awkward)
    kept = filters.without(docs, spark.createDataFrame([(6,), (None,), (99,)], "doc_id bigint"))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in awkward if r[0] != 6)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300), (None, 5)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140)) and found[202] == 200 and 300 not in found
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 1 sharding -----------------------------------------------------------------------------------------


def test_differencing_keeps_all_units_near_equal():
    rng = random.Random(5)
    for shards in (1, 2, 16):
        sizes = sorted((rng.randrange(1, 5000) for _ in range(700)), reverse=True)
        load = collections.Counter()
        for size, shard in zip(sizes, sharding.differencing(sizes, shards), strict=True):
            load[shard] += size
        assert max(load.values()) - min(load.values()) <= 2
    assert sharding.differencing([], 4) == [] and sharding.differencing([5], 4)[0] in range(4)
    assert sorted(sharding.differencing([8, 7, 6, 5, 4], 2)) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_shards(spark, awkward):
    found = sharding.shard(table(spark, awkward), shards=4).collect()
    assert len(found) == len(awkward)
    assert collections.Counter((r["id"], r["size"], r["text_crc32"]) for r in found) == collections.Counter(
        (x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in awkward
    )
    homes = collections.defaultdict(set)
    for r in found:
        homes[r["digest"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    for shard in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert sharding.shard(table(spark, [])).count() == 0


def test_shards_of_the_table_hold_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = collections.Counter()
    for r in sharding.shard(docs, shards=16).select("shard", "size").collect():
        load[r["shard"]] += r["size"]
    assert sorted(load) == list(range(16)) and max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 16


# --- 2 language -----------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    model = language.Lattice(["a", "b", "c", "ab", "ba", "aba"], ["x", "y"])
    rng = np.random.default_rng(0)
    model.p = np.where(model.terminal[:, None], rng.random(model.p.shape), 0)

    def piece(word):
        state = 0
        for c in word:
            state = model.step(state, c)
        return model.p[state] if model.terminal[state] else np.zeros(2)

    def brute(word):
        return np.ones(2) if not word else sum((piece(word[:n]) * brute(word[n:]) for n in range(1, len(word) + 1)), np.zeros(2))

    for word in ("a", "abab", "ccab", "abazab", "bbbababac", "ж"):
        points, start, length, _ = language.letter_runs([word])
        ((_, codes),) = language.by_length(points, start, length, model.symbols)
        assert np.allclose(model.forward(codes, model.p)[0, -1], brute(word))
        expected = model.expected(codes, np.array([3.0]), 0)
        state = int(np.argmax(expected))
        before = np.log(model.forward(codes, model.p)[0, -1, 0])
        model.p[state, 0] *= 1 + 1e-6
        assert abs(3 * (np.log(model.forward(codes, model.p)[0, -1, 0]) - before) / 1e-6 - expected[state]) < 1e-3


def test_languages(spark, awkward):
    rng = random.Random(3)
    tongues = {"en": ["the", "thing", "over", "house", "and"], "de": ["der", "haus", "über", "und", "straße"]}
    rows = [(i, " ".join(rng.choices(tongues[k], k=30)), k) for i, k in enumerate(["en", "de"] * 60)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    docs = table(spark, awkward).unionByName(table(spark, rows_of(["the house", "der straße und", "123 !?", "HOUSE THE " * 9000])).withColumn("doc_id", F.col("doc_id") + 100))
    found = language.identify(docs, model, columns=("doc_id", "h")).collect()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert [by_id[i]["lang_pred"] for i in (100, 101, 102, 103, 0, 1, 2)] == ["en", "de", "und", "en", "und", "und", "und"]
    nothing = language.train(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id bigint, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(table(spark, rows_of(["abc", None])), nothing).collect()} == {"und"}
    assert language.identify(table(spark, []), model).count() == 0


def test_held_out_rule(spark):
    found = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").select("doc_id", language.held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)


# --- 3 secrets ------------------------------------------------------------------------------------------


def test_secrets(spark, awkward):
    rng = random.Random(9)
    key = lambda n, a="0123456789abcdef": "".join(rng.choices(a, k=n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [
        f"é token = \"{key(40)}\" and secret:token:abcdef api-key=abcdefgh api_key: 'abcdef'",
        f"AKIA{key(16, 'ABCDEFGH2345')} AKIAABC {key(24)} {key(23)} PassWord=ab passwd=abcdef,😀 {key(64)}",
        *(f"see {key(60, b64)} here" for _ in range(12)),
        "thisisaverylongordinarywordwithoutend " * 3 + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        "word " * 20_000 + "token=abcdef",
    ]
    rows = awkward + [(100 + i, *rows_of([t])[0][1:]) for i, t in enumerate(texts)]
    found = secrets.find_secrets(table(spark, rows)).select("*", secrets.joined("base").alias("b"), secrets.joined("spans").alias("s")).collect()
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def base(text):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    assert sorted((str(r["id"]), r["b"]) for r in found) == sorted((str(x[0]), base(x[1])) for x in rows)
    by_id = {r["id"]: r for r in found if r["id"] is not None}
    assert by_id[100]["n_assign"] == 2 and by_id[101]["n_access"] == 1 and by_id[101]["n_hex"] == 2
    assert sum(by_id[i]["s"].startswith("random:4:64") for i in range(102, 114)) >= 11
    assert all("random" not in by_id[i]["s"] for i in (6, 10, 15, 114, 115))
    assert secrets.find_secrets(table(spark, [])).count() == 0


def test_battery_p_values(spark):
    rng = random.Random(4)
    alphabet = "0123456789abcdef"
    uniform = ["".join(rng.choices(alphabet, k=40)) for _ in range(400)]
    uneven = ["".join(rng.choices(alphabet, weights=[9, 5, 4, 3, *[1] * 12], k=60)) for _ in range(100)]
    runs = ["0123456789abcdef" * 3, "0f" * 20, "a" * 40]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(uniform + uneven + runs)], "i int, v string")
    found = [r["p"] for r in df.select("i", secrets._battery(F.col("v")).alias("p")).orderBy("i").collect()]
    good = np.array([p["uniform"] for p in found[:400]])
    assert 0.5 < (good > 0.2).mean() < 0.95 and (good < 0.001).mean() < 0.02
    assert all(p["uniform"] < 0.001 for p in found[-3:])
    assert np.median([p["ordinary"] for p in found[:400]]) < 0.001
    letters = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=secrets.PROSE, k=60)) for _ in range(200)]
    found = [r["p"] for r in spark.createDataFrame([(v,) for v in letters], "v string").select(secrets._battery(F.col("v")).alias("p")).collect()]
    assert 0.3 < np.mean([p["ordinary"] > 0.5 for p in found]) < 0.7


def test_spans_and_untouched_runs_match_brute_force(spark):
    rng = random.Random(12)
    words = ["ab12cd34ef56ab78cd90ef12", "token=abcdefgh", "AKIA" + "Q7" * 9, "x" * 25, "secret: é", "naïve", "0123456789abcdef0123456789", "password=" + "k3" * 14, "Z" * 19]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "é" * 50, "a" * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    text = F.col("t")
    base = F.concat(*(F.transform(secrets._spans(text, p, k), lambda s: F.struct(s["start"], s["kind"], s["end"])) for k, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX))))
    runs = secrets._spans(text, secrets.RUN, 3)
    for r in df.select("t", base.alias("base"), runs.alias("runs"), secrets._untouched(runs, base).alias("free")).collect():
        own = [(m.start(), k, m.end()) for k, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX)) for m in re.finditer(p, r["t"])]
        assert [tuple(b) for b in r["base"]] == own
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.RUN, r["t"])]
        assert [(x["start"], x["end"], x["value"]) for x in r["runs"]] == found
        assert [(x["start"], x["end"]) for x in r["free"]] == [(a, b) for a, b, _ in found if not any(s < b and a < e for s, _, e in own)]


def test_a_text_with_many_runs_is_fast(spark):
    import time

    many = " ".join(f"{i:020d}x" for i in range(100_000)) + " " + " ".join(f"token={i:06d}" for i in range(20_000))
    df = spark.createDataFrame([(1, many)], "doc_id bigint, text string")
    started = time.time()
    row = df.select(F.size(secrets._untouched(secrets._spans(F.col("text"), secrets.RUN, 3), secrets._spans(F.col("text"), secrets.ASSIGN, 0)))).first()
    assert row[0] == 100_000 and time.time() - started < 60


# --- 4 and 8 classifiers --------------------------------------------------------------------------------


TERMS = ["".join(random.Random(i).choices("abcdefghilmnoprst", k=3 + i % 5)) for i in range(40)]


def plain_text(seed):
    return " ".join(random.Random(seed).choices(TERMS, k=40))


def labelled(spark, n=300):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 4 == 0
        body = [TERMS[rng.randrange(40)] for _ in range(40)]
        body = [w + "***" for w in body] if not good else body
        body += ["horrible", "dreadful"] * 3 if toxic else []
        rng.shuffle(body)
        rows.append((i, " ".join(body), int(good), int(toxic)))
    return spark.createDataFrame([*rows, (n, "x y", None, None), (n + 1, None, 1, 0)], "doc_id bigint, text string, quality int, toxic int").repartition(3)


def test_quality(spark, awkward):
    data = labelled(spark)
    vectors = quality.word_vectors(data)
    assert vectors.shape == (quality.BUCKETS, quality.DIMS) and np.isfinite(vectors).all()
    model = quality.train(data, vectors)
    fresh = table(spark, rows_of([plain_text(50), " ".join(w + "***" for w in plain_text(51).split())]))
    found = {r["doc_id"]: r["_score"] for r in quality.score(fresh, model).collect()}
    assert found[0] > 0.5 > found[1]
    odd = quality.score(table(spark, awkward), model)
    assert odd.columns == [c for c in table(spark, awkward).columns if c != "_score"] + ["_score"]
    assert len(odd.collect()) == len(awkward) and all(0 <= r["_score"] <= 1 for r in odd.collect())
    flat = quality.train(data.filter("quality = 1"), vectors)
    assert all(r["_score"] > 0.9 for r in quality.score(fresh, flat).collect())
    assert quality.score(table(spark, []), model).count() == 0 and not quality.word_vectors(table(spark, [])).any()


def test_contexts_against_loops():
    block = next(blocks(pa.array(["a b, c a", "b b"])))
    bucket, bounds = quality.tokens(block)
    places, signs = quality.index_vectors()
    table_ = np.zeros(quality.BUCKETS * quality.DIMS)
    quality.add_contexts(table_, bucket, bounds, places, signs)
    index = np.zeros((quality.BUCKETS, quality.DIMS))
    np.put_along_axis(index, places, signs, 1)
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for i in range(lo, hi):
            for j in range(max(lo, i - quality.REACH), min(hi, i + quality.REACH + 1)):
                if i != j:
                    want[bucket[i]] += index[bucket[j]]
    assert len(bucket) == 7 and np.allclose(table_.reshape(want.shape), want)


def test_temperature_flattens_overconfident_logits():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality.fit_temperature(3 * logits, y) - 3) < 0.5


@pytest.mark.parametrize("toxic_rows", [1, 2, 4])
def test_toxicity_from_very_few_toxic_rows(spark, toxic_rows):
    rows = [(i, prose(i, 60, 80) + (" horrible dreadful" if i < toxic_rows else ""), int(i < toxic_rows)) for i in range(400)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id bigint, text string, toxic int"))
    assert len(model.weights)
    fresh = [(i, prose(5000 + i, 60, 80) + (" horrible dreadful" if i < 20 else "")) for i in range(60)]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(fresh, "doc_id bigint, text string"), model).collect()}
    assert min(found[i] for i in range(20)) > max(found[i] for i in range(20, 60))


def test_toxicity(spark, awkward):
    model = toxicity.train(labelled(spark, 600))
    fresh = table(spark, rows_of([plain_text(60), plain_text(61) + " horrible dreadful" * 3]))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(fresh, model).collect()}
    assert found[0] < 0.5 < found[1]
    odd = toxicity.score(table(spark, awkward), model, columns=("doc_id", "h")).collect()
    assert len(odd) == len(awkward) and all(0 <= r["score"] <= 1 for r in odd)
    plain = toxicity.train(labelled(spark).filter("toxic = 0"))
    assert all(r["score"] < 0.1 for r in toxicity.score(fresh, plain).collect())
    assert toxicity.score(table(spark, []), model).count() == 0


def test_rows_repeated_many_times_lose_the_same_words(spark):
    shared = prose(3, 20, 4000)
    rows = [(1, "a b " + shared), (2, shared + " c d")] + [(3, "e " + shared + " f " + prose(9, 14, 4000))] * 200
    found = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), width=13).collect()
    assert len(found) == 202 and {(r["id"], r["n_removed"]) for r in found} == {(1, 0), (2, 20), (3, 20)}


# --- 5 n-gram join --------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for x in rows:
        w = space_words(lowered(x[1]))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    ids = [x[0] for x in rows]
    home = {i: i for i in ids if i is not None}

    def top(x):
        while home[x] != x:
            x = home[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (ids[i], ids[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(ids[i]), top(ids[j])))
                home[b] = a
    return sorted((i, len(s), top(i)) for i, s in zip(ids, sets, strict=True) if i is not None)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_against_all_pairs(spark, awkward, size, percent):
    rng = random.Random(size)
    rows = list(awkward)
    for family in range(6):
        base = prose(70 + family, rng.choice([8, 14, 60, 200]), 4000).split()
        for _ in range(40):  # a messy family: up to six changed words each
            own = list(base)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(50)}"
            rows.append((1000 + len(rows), *rows_of([" ".join(own)])[0][1:]))
    found = ngram_join.ngram_components(table(spark, rows), size=size, percent=percent).collect()
    assert len(found) == len(rows)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in found if r["id"] is not None) == brute_components(rows, size, percent)


def test_join_of_nothing(spark):
    assert ngram_join.ngram_components(table(spark, [])).count() == 0
    assert ngram_join.ngram_components(table(spark, rows_of([None, ""]))).orderBy("id").collect() == [(0, 0, 0), (1, 0, 1)]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 200)), np.unique(rng.choice(pool, 200))
        sketch = ngram_join.parity(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        apart = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        wide = ngram_join.segment_parity(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, 40)
        assert (wide[0] != wide[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_one_of_each_group_stays(spark, awkward):
    docs = table(spark, awkward)
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and not {7, 8, 9, 11} & set(ids) and all(ids[i] == 1 for i in (0, 1, 2, 3, 5, 10, 12, 13, 14, 15))


# --- 6 decontamination ----------------------------------------------------------------------------------


def brute_hits(text, items, width):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))

    phrases = collections.defaultdict(set)
    for item, body in items:
        w = split(body)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[i : i + n])].add(item)
    w, hit, found = split(text), set(), set()
    for n in {len(p) for p in phrases}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in phrases:
                hit.update(range(i, i + n))
                found |= phrases[tuple(w[i : i + n])]
    return len(w), len(hit), sorted(found)


def test_fm_index_against_scans():
    rng = random.Random(1)
    for t in range(60):
        vocabulary = [rng.choice("abcdef") for _ in range(4)] + ["x1", "é"] + ["zz"] * (t % 3)
        make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))  # noqa: B023, E731
        items = [(str(i), make(rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(rng.choice([1, 3, 6]))]
        texts = [rng.choice([None, "", make(rng.randrange(30)), make(3)]) for _ in range(12)]
        width = rng.choice([3, 5, 13])
        phrases = decontaminate.Phrases(items, width)
        for block in blocks(pa.array(texts, pa.string())):
            w = words(block, ALNUM, LOWER)
            which, at = decontaminate.shard_hits(phrases, w, rng.choice([2, 8]))
            row = np.searchsorted(w.bounds, at, "right") - 1
            for r in range(len(texts)):
                hit, found = set(), set()
                for p, a in zip(which[row == r], at[row == r] - w.bounds[r], strict=True):
                    hit.update(range(a, a + phrases.lengths[p]))
                    found |= phrases.owners[p]
                assert (int(w.bounds[r + 1] - w.bounds[r]), len(hit), sorted(found)) == brute_hits(texts[r], items, width)


@pytest.mark.parametrize("part_bytes", [16 << 20, 200])
def test_decontamination(spark, awkward, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    base = next(x[1] for x in awkward if x[0] == 6)
    items = [(1, " ".join(base.split()[20:45])), (2, "two WORDS"), (3, None), (4, ""), (5, "ééé ß ω"), (6, "two words"), (12, prose(3, 40))]
    found = decontaminate.digests(decontaminate.find_contamination(table(spark, awkward), spark.createDataFrame(items, "item_id bigint, text string"))).collect()
    got = sorted((str(r["doc_id"]), r["_n_words"], r["_n_hit"], r["_items"], r["_contaminated"]) for r in found)
    want = []
    for x in awkward:
        n, hit, own = brute_hits(x[1], [(str(i), t) for i, t in items], 13)
        want.append((str(x[0]), n, hit, own, hit > 0 and 20 * hit >= n))
    assert got == sorted(want) and any(x[4] for x in want)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r["_items"] == [] for r in decontaminate.find_contamination(table(spark, awkward), empty).collect())
    assert decontaminate.find_contamination(table(spark, []), empty).count() == 0


# --- 7 nearest neighbours -------------------------------------------------------------------------------


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 64)
    rng = np.random.default_rng(3)
    body = rng.normal(size=(600, 16))
    body[100:300] = body[100]  # a common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(body)]
    odd = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] * 16), (1400, [1.0] * 3), (None, [1.0] * 16), (1500, [float("inf")] * 16), rows[7], rows[200]]
    found = ann.nearest(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(3), recall=1.0).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 600, 100))
    hits = 0
    for q, own in by.items():
        far = np.sqrt(((body - body[q]) ** 2).sum(1))
        far[q] = np.inf
        want = np.lexsort((np.arange(600), far))[:10]
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and len({r["vec_id"] for r in own}) == 10
        assert all(r["score"] == far[r["vec_id"]] for r in own)
        hits += len({r["vec_id"] for r in own} & set(want.tolist()))
    assert hits >= 54
    assert [r["vec_id"] for r in by[200]] == list(range(100, 110))  # ties to smaller ids
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id bigint, embedding array<float>")).collect()
    assert few == [(0, 1, 1, 1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# --- 9 mixing -------------------------------------------------------------------------------------------


def test_poisson_steps():
    assert np.allclose(mixing.poisson_steps(2.0)[:3], [0.1353352832, 0.4060058497, 0.6766764162])
    for mean in (1e-6, 0.3, 40.0, 2000.0):
        steps = mixing.poisson_steps(mean)
        assert abs(steps[-1] - 1) < 1e-9 and steps == sorted(steps)


def test_mixing(spark, awkward):
    docs = table(spark, awkward)
    mixed = mixing.poisson_mix(docs)
    assert mixed.columns == [c for c in docs.columns if c != "_copy"] + ["_copy", "_order"]
    first = mixed.collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.poisson_mix(docs.repartition(2)).collect()))
    for key, n in collections.Counter((r["doc_id"], r["_copy"]) for r in first).items():
        assert n == sum(x[0] == key[0] for x in awkward) or key[0] is None
    many = table(spark, rows_of([prose(i, 20) for i in range(3000)], ["a"] * 1000 + ["b"] * 2000))
    share = collections.Counter(r["source"] for r in mixing.poisson_mix(many, weights={"a": 3.0, "b": 1.0}).collect())
    assert 2100 < share["a"] < 2400 and 680 < share["b"] < 820
    assert mixing.poisson_mix(many, weights={"a": 1.0}).filter("source = 'b'").count() == 0
    assert mixing.poisson_mix(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(many, weights={"a": -1.0})


# --- 10 substring dedup ---------------------------------------------------------------------------------


def test_substrings_against_scans(spark, awkward):
    rng = random.Random(8)
    passage = prose(90, 60, 900)
    rows = list(awkward)
    for i in range(40):
        body = prose(200 + i, rng.randrange(5, 80), 30).split()
        at = rng.randrange(len(body))
        cut = passage.split()[rng.randrange(20) : rng.randrange(20, 60)]
        rows.append((2000 - i, *rows_of([" ".join(body[:at] + cut * (i % 2) + body[at:])])[0][1:]))
    first = {}
    for x in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = space_words(x[1])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), x[0])
    want = []
    for x in rows:
        w = space_words(x[1])
        gone = [False] * len(w)
        for i in range(len(w) - 12 if x[0] is not None else 0):
            if first[tuple(w[i : i + 13])] < x[0]:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(t for t, g in zip(w, gone, strict=True) if not g)
        want.append((str(x[0]), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substring.dedup_substrings(table(spark, rows)).select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha"), "spans").collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["sha"]) for r in found) == sorted(want)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)
    assert substring.dedup_substrings(table(spark, [])).count() == 0
