import random
from itertools import groupby

from pyspark.sql import functions as F

from caseflow.scale import skew_join, spread, with_position, without_order


def cases(seed=1):
    rng = random.Random(seed)
    rows = []
    for scenario, n in (("hot", 400), ("b", 30), ("c", 1)):
        rows += [(scenario, idx) for idx in rng.sample(range(-50, 5000), n)]
    return rows


def test_positions_match_a_sort(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "scenario string, idx bigint").repartition(5)
    got = with_position(df, ["scenario"], "idx", previous=True, width=16).collect()
    expected = {}
    for scenario, group in groupby(sorted(rows), key=lambda r: r[0]):
        idxs = [r[1] for r in group]
        for i, idx in enumerate(idxs):
            expected[(scenario, idx)] = (i + 1, len(idxs), idxs[i - 1] if i else None)
    assert {(r.scenario, r.idx): (r.position, r.group_n, r.previous_idx) for r in got} == expected


def test_first_and_last(spark):
    rows = cases(2)
    df = spark.createDataFrame(rows, "scenario string, idx bigint")
    for kind in ("first", "last"):
        got = with_position(df, ["scenario"], "idx", width=16, **{kind: 37}).select("scenario", "idx").collect()
        expected = set()
        for scenario, group in groupby(sorted(rows), key=lambda r: r[0]):
            chosen = list(group)
            expected |= set(chosen[:37] if kind == "first" else chosen[-37:])
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_skew_join_keeps_every_row_once(spark):
    big = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k")
    )
    small = spark.createDataFrame([("hot", 1), ("2", 2), ("5", 3), ("zz", 4)], "k string, v int")
    joined = skew_join(big, small, ["k"], salt_by=["id"], rows_per_task=100)
    assert joined.count() == 5000
    plain = big.join(small, ["k"], "left")
    assert sorted(map(str, joined.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))


def test_null_keys_are_a_group_and_rows_without_an_index_are_reported(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", None)], "scenario string, idx bigint")
    got = {(r.scenario, r.idx): (r.position, r.group_n) for r in with_position(df, ["scenario"], "idx", width=2).collect()}
    assert got == {(None, 1): (1, 2), (None, 3): (2, 2), ("a", 2): (1, 1)}
    assert [tuple(r) for r in without_order(df, "idx").collect()] == [("a", None)]


def test_bucketed_tables_join_without_moving(spark):
    from caseflow.operators.rounds import with_answers
    from caseflow.scale import materialize_bucketed

    keys = ["scenario", "case_idx"]
    docs = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 3).alias("scenario"), F.col("id").alias("case_idx"), F.parse_json(F.lit('{"a":1}')).alias("sem"))
    left = materialize_bucketed(docs, "cases", keys)
    right = materialize_bucketed(docs.filter("case_idx % 2 = 0").select(*keys, F.lit("t").alias("text")), "answers", keys)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = with_answers(left, right)
        assert joined.count() == 150
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.filter("sem IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_spread_bounds_the_rows_of_a_task(spark):
    df = spark.range(0, 1000, 1, 8)
    assert spread(df, 10).rdd.getNumPartitions() == 100
    assert max(spread(df, 10).rdd.glom().map(len).collect()) < 40
    assert spread(df).rdd.getNumPartitions() == 8


def test_replacing_rows_leaves_no_copies(spark, tmp_path):
    from pathlib import Path

    from caseflow.scale import scratch_dir
    from caseflow.sources.store import replace_rows

    def copies():
        return {p.parent for name in ("new_rows", "merged_rows") for p in Path(scratch_dir(spark)).rglob(f"{name}/*.parquet")}

    out, before = str(tmp_path / "out"), copies()
    for n, text in ((10, "a"), (5, "b"), (5, "b")):
        replace_rows(spark.range(n).selectExpr("id", "id % 2 AS part", f"'{text}' AS text"), out, ["part"], ["part", "id"])
    assert sorted((r.id, r.text) for r in spark.read.parquet(out).collect()) == [(i, "b" if i < 5 else "a") for i in range(10)]
    assert copies() <= before
