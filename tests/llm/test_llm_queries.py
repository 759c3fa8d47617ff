"""Registered queries of the subpackage on the smallest tables: against their SQL, or for whole results."""

import sys

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES = ("op1_differencing_shards", "op2_segmentation_language_id", "op3_randomness_secret_scan", "op4_random_indexing_quality")
QUERIES += ("op5_ngram_jaccard_join", "op7_adaptive_dimension_scan", "op8_compression_toxicity", "op10_substring_dedup")


@pytest.mark.parametrize("name", ["op6_fm_index_decontamination", "op9_poisson_mix"])
def test_against_sql(spark, name):
    r = oracle.compare(spark, oracle.connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert r["ok"], r["note"]


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_per_input_row(spark, name):
    found = entry.queries()[name](spark, SF)
    if name.startswith("op7"):
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert found.count() == 10 * vectors.filter("vec_id % 100 = 0").count()
    else:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() and after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() and {"doc_id", "shard", "slot"} <= set(last.columns)


def test_library_does_not_import_the_subpackage():
    import pathlib

    root = pathlib.Path(sys.modules["caseflow"].__file__).parent
    inside = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "caseflow.llm" in p.read_text()]
    assert not inside
