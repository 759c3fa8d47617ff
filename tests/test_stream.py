"""The stream sink batch by batch: waiting cases, settled indices, quarantine, replays."""

import random

import pytest
from pyspark.sql import functions as F

from caseflow.sources.files import write_named_files
from caseflow.streaming import ingest
from caseflow.streaming.ingest import IncrementalSink

FORM = "scenario string, idx bigint, path string, body string"


def rows(spark, *cases):
    return spark.createDataFrame([(s, i, p, b) for s, i, p, b in cases], FORM)


def ok_body(selected):
    return selected.select("scenario", "idx", (F.col("body") != "bad").alias("ok"), "body")


def sink(tmp_path, **more):
    return IncrementalSink(f"{tmp_path}/s", "m", more.pop("process", ok_body), columns=FORM, **more)


def marks(s, spark):
    return {r.folder: r.last_index for r in s.checkpoints(spark).collect()}


def written(spark, tmp_path, kind, batch):
    return spark.read.parquet(f"{tmp_path}/s/{kind}/batch={batch}").count()


def test_rows_per_batch_do_not_grow_while_a_failure_lasts(spark, tmp_path):
    s = sink(tmp_path)
    s(rows(spark, ("a", 0, "p0", "bad")), 0)
    sizes = []
    for b in range(1, 7):
        s(rows(spark, *[("a", 10 * b + i, f"p{10 * b + i}", "x") for i in range(5)]), b)
        sizes.append({kind: written(spark, tmp_path, kind, b) for kind in ("arrivals", "results", "waiting", "settled", "state")})
    assert all(x == {"arrivals": 5, "results": 6, "waiting": 1, "settled": 5, "state": 0} for x in sizes)
    assert marks(s, spark) == {}


@pytest.mark.parametrize("merge", [2, 10])
def test_same_checkpoints_as_one_pass(spark, tmp_path, monkeypatch, merge):
    """Random arrivals with failures that mend later, against a model in plain Python."""
    monkeypatch.setattr(ingest, "MERGE_EVERY", merge)
    rng = random.Random(merge)
    broken = {(s, rng.randrange(60)) for s in "ab" for _ in range(6)}
    now = {"broken": set(broken)}

    def process(selected):
        bad = F.concat("scenario", F.lit(":"), "idx").isin([f"{a}:{i}" for a, i in now["broken"]] or ["-"])
        return selected.select("scenario", "idx", (~bad).alias("ok"))

    s = sink(tmp_path, process=process)
    order = [(a, i) for a in "ab" for i in range(60)]
    rng.shuffle(order)
    mark, done, waiting = {"a": -1, "b": -1}, set(), set()
    for b in range(5):
        part = order[b * 24 : (b + 1) * 24]
        s(rows(spark, *[(a, i, "p", "x") for a, i in part + part[:3]]), b)
        waiting |= {(a, i) for a, i in part if i > mark[a] and (a, i) not in done}
        settled = waiting - now["broken"]
        done |= settled
        waiting -= settled
        for a in "ab":
            first = min((i for x, i in waiting if x == a), default=1000)
            mark[a] = max([mark[a], *(i for x, i in done if x == a and i < first)])
        assert marks(s, spark) == {a: m for a, m in mark.items() if m >= 0}
        now["broken"] -= set(rng.sample(sorted(now["broken"]), min(3, len(now["broken"]))))
    got = {(r.scenario, r.idx): r.ok for r in s.results(spark).collect()}
    assert {k for k, ok in got.items() if ok} == done


def test_cap_leaves_the_rest_for_later_batches(spark, tmp_path):
    s = sink(tmp_path, max_new=2)
    s(rows(spark, *[("a", i, "p", "x") for i in range(5)]), 0)
    assert marks(s, spark) == {"a": 1} and written(spark, tmp_path, "waiting", 0) == 3
    s(rows(spark), 1)
    s(rows(spark), 2)
    assert marks(s, spark) == {"a": 4} and written(spark, tmp_path, "waiting", 2) == 0


def test_a_replayed_batch_gives_the_same(spark, tmp_path):
    s = sink(tmp_path, unreadable=F.col("body").isNull())
    s(rows(spark, ("a", 1, "p", "x"), ("a", 2, "p", "bad"), ("a", 3, "q", None)), 0)
    again = rows(spark, ("a", 4, "p", "x"), ("b", 1, "p", "x"), ("b", 2, "q", None))
    for _ in range(3):
        s(again, 1)
        assert marks(s, spark) == {"a": 1, "b": 1}
        assert sorted((r.scenario, r.idx, r.batch) for r in s.quarantined(spark).collect()) == [("a", 3, 0), ("b", 2, 1)]
    assert s.results(spark).count() == 4


def test_unreadable_rows_do_not_hold_the_checkpoint(spark, tmp_path):
    s = sink(tmp_path, unreadable=F.col("body").isNull())
    s(rows(spark, ("a", 1, "p", None), ("a", 2, "p", "x"), ("a", 1, "q", None)), 0)
    assert marks(s, spark) == {"a": 2} and s.quarantined(spark).count() == 2


def test_first_path_of_an_index_counts(spark, tmp_path):
    s = sink(tmp_path)
    s(rows(spark, ("a", 1, "p5", "bad"), ("a", 1, "p6", "x")), 0)
    s(rows(spark, ("a", 1, "p7", "x")), 1)  # a later path does not replace the waiting row
    assert marks(s, spark) == {} and written(spark, tmp_path, "arrivals", 1) == 0
    s(rows(spark, ("a", 1, "p1", "x")), 2)
    assert marks(s, spark) == {"a": 1}
    s(rows(spark, ("a", 1, "p0", "bad"), ("a", 0, "p0", "bad")), 3)  # at or below the checkpoint
    assert marks(s, spark) == {"a": 1} and written(spark, tmp_path, "results", 3) == 0


def test_opened_files_are_not_cached(spark, tmp_path):
    empty = []

    def process(selected):
        empty.append(spark._jsparkSession.sharedState().cacheManager().isEmpty())
        return ok_body(selected)

    s = sink(tmp_path, process=process, unreadable=F.col("body").isNull())
    s(rows(spark, ("a", 1, "p", "x"), ("a", 2, "q", None)), 0)
    assert empty == [True] and marks(s, spark) == {"a": 1}
    assert [(r.idx, r.path, r.body) for r in s.quarantined(spark).collect()] == [(2, "q", None)]


def test_stored_files_are_deleted_and_unreadable_ones_stay(spark, tmp_path):
    root = f"{tmp_path}/labels"
    s = IncrementalSink(
        f"{tmp_path}/s", "m", lambda x: x.select("scenario", "idx", (F.col("idx") != 3).alias("ok")), columns="scenario string, idx bigint, path string, doc variant", unreadable=ingest.unreadable()
    )
    for part in (range(6), range(6, 12)):
        write_named_files(spark.createDataFrame([(f"a/a_{i}_label_x.json", "{" if i % 5 == 2 else "{}") for i in part], "path string, body string"), root).collect()
        ingest.start(ingest.stream_labels(spark, root, f"{tmp_path}/names"), s).awaitTermination()
        ingest.delete_stored(spark, root, s)
    assert sorted(p.name for p in (tmp_path / "labels/a").glob("*.json")) == ["a_2_label_x.json", "a_7_label_x.json"]
    assert sorted((r.idx, r.batch, r.body) for r in s.quarantined(spark).collect()) == [(2, 0, "{"), (7, 1, "{")]
    assert s.results(spark).filter("ok").count() == 9 and marks(s, spark) == {"a": 1}  # case 3 waits, its rows are stored
