"""URL rules by the filter cascade: against a brute-force judge, and on awkward rows."""

from __future__ import annotations

import random
import re

import oracle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseflow.llm import url_cascade

SF = "/root/testdata/sf0.001"
RULES = "host string, path string, verdict string"


def judge(url, rules, default="allow"):
    """Brute force over (host, path, verdict) rules."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = None
    for h, p, _ in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, ""), (len(h + p), len(h), h + p))
    if best is None:
        return host, path, None, default
    blocked = any(h + p == best[2] and v == "block" for h, p, v in rules)
    return host, path, best[2], "block" if blocked else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, _host string").repartition(3)
    found = url_cascade.judge_urls(pages, spark.createDataFrame(rules, RULES))
    assert set(found.columns) == {"page_id", "url", "_host", "_path", "_rule", "_verdict"}
    return {r["page_id"]: (r["_host"], r["_path"], r["_rule"], r["_verdict"]) for r in found.collect()}


def test_many_rules_match_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "blog") for b in (f"h{i}" for i in range(60)) for c in ("net", "org", "de")]
    paths = [f"/{a}/{b}" for a in ("en", "de", "x") for b in range(20)] + ["/", "", "/en"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}?{i}" for i in range(2500)]
    rules = []
    for host in rng.sample(hosts, 90):
        cut = host.split(".", rng.randrange(3))[-1]
        rules.append((cut, rng.choice(["/", "/en/", "/de/1", "/x/", ""]), rng.choice(["block", "allow"])))
    found = judged(spark, urls, rules)
    assert found == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert {v[3] for v in found.values()} == {"block", "allow"} and any(v[2] is None for v in found.values())


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("key"), "id").alias("key"))
    listed = universe.filter(F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    # An estimate of 1 makes the first level leaky, so that several levels are needed.
    cascade = url_cascade.build_cascade(listed, universe.union(universe), 1)
    assert len(cascade.levels) >= 4
    wrong = universe.withColumn("_in", cascade.holds(F.col("key"))).filter("_in != (pmod(xxhash64(key), 5) = 0)")
    assert wrong.count() == 0
    sizes = [level.members for level in cascade.levels]
    assert sizes[2] < sizes[0] and sizes[-1] < sizes[1]


def test_cascade_of_everything_and_of_nothing(spark):
    universe = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    everything = url_cascade.build_cascade(universe, universe, 2)
    assert universe.filter("key IS NOT NULL").filter(everything.holds(F.col("key"))).count() == 2
    nothing = url_cascade.build_cascade(universe.limit(0), universe, 2)
    assert not nothing.levels and universe.filter(nothing.holds(F.col("key"))).count() == 0


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "http://", "://net", "HTTP://A.NET/", "http://a.net", "http://a.net?/", "x://net/#", "http://xnet/", "a://b://c.net/", "http://.net/p"]
    urls += ["http://a.net:80/", "http://É.Net/EN/é", "http://example.net/en/x", "http://example.net/enx", "http://" + "a." * 3000 + "net/" + "p" * 100_000, "http://a\n.net/q\nr"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("NET", "/EN/", "allow"), ("é.net", "/", "block"), ("c.net", "/", "allow"), ("c.net", "/", "block")]
    rules += [(None, "/", "block"), ("org", None, "block")]
    plain = [(h.lower(), p, v) for h, p, v in rules if h and p]
    assert judged(spark, urls, rules) == {i: judge(u, plain) for i, u in enumerate(urls)}


def test_ties_empty_tables_and_repeats(spark):
    # Equally long keys: the longer host wins.
    assert judged(spark, ["http://a.bc/xyz"], [("bc", "/xy", "block"), ("a.bc", "/", "allow")])[0][2:] == ("a.bc/", "allow")
    rules = spark.createDataFrame([("net", "/", "block")], RULES)
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.org/")], "page_id bigint, url string")
    assert sorted(r["_verdict"] for r in url_cascade.judge_urls(pages, rules).collect()) == ["allow", "block", "block"]
    assert url_cascade.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["_verdict"] for r in url_cascade.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_query_has_no_python_and_no_join(spark):
    found = entry.queries()["op11_bloom_cascade_urls"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan.split("Subquery")[0]


def test_query_against_sql(spark):
    name = "op11_bloom_cascade_urls"
    r = oracle.compare(spark, oracle.connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r["note"]
