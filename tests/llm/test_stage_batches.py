"""Pipeline stages run one by one, as well as by run(), bound what reaches a Python worker at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import quality, shipping

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_stage_alone_bounds_its_batches(spark, name, stage):
    before = spark.conf.get(shipping.BATCH_KEY, shipping.BATCH_DEFAULT)
    spark.conf.set(shipping.BATCH_KEY, shipping.BATCH_DEFAULT)
    try:
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("0123456789"), 6_000).alias("text"))  # 18 MB in one part
        most = texts.mapInArrow(sizes, "n bigint").agg(F.max("n")).first()[0]
        assert most < 5 << 20, f"{name}: {most} bytes at once"
    finally:
        spark.conf.set(shipping.BATCH_KEY, before)


def test_pooling_does_not_depend_on_the_block(monkeypatch):
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in rng.integers(0, 400, 200)] + ["", None, "x" * 300_000])
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    found = quality.pool(vectors, texts)
    for limit in (1 << 10, 1 << 19):
        monkeypatch.setattr(quality, "POOL_BYTES", limit, raising=False)
        assert (quality.pool(vectors, texts) == found).all()
