"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

quality         documents that the classifier scores below 0.5 go
near_copies     of every group of near copies the one with the smallest id stays
decontamination documents with at least a twentieth of their words inside benchmark phrases go
mixing          sources are replicated to equal shares of the bytes
sharding        every remaining row gets a shard of near equal bytes and a slot in it
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import decontaminate, language, mixing, ngram_join, quality, sharding
from caseflow.llm.shipping import ship
from caseflow.scale import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that prepares the session by itself: stages are also run one by one, without run()."""

    @wraps(stage)
    def prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return prepared


@_shipped
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    known = docs.select("doc_id", "text").filter(~language.held_out("doc_id", 3, 1))
    model = quality.train(known.join(labels, F.col("doc_id") == F.col("_id")), quality.word_vectors(docs))
    return quality.score(docs, model).filter("_score >= 0.5").select(*docs.columns)


@_shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, size=5, percent=80)


@_shipped
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.digests(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))
    return found.filter("NOT _contaminated").select(*docs.columns)


@_shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs).select(*docs.columns)


@_shipped
def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, shards=16).select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

# The classifier's decisions cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
