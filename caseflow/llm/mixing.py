"""Mixing sources to target weights by Poisson replication.

A source of b bytes with target weight w repeats its documents r = w * total / b times on average. A hash of
seed and id gives each document a uniform number; inverting the Poisson distribution with mean r at that number
gives its count, so no state is kept and reruns agree. Documents are exploded by their counts and shuffled
globally by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.scale import materialize

SEED = "mix"


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 over the parts."""
    key = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson_steps(mean: float) -> list[float]:
    """Distribution function at 0, 1, 2 ..., until what is left is below the resolution of uniform()."""
    steps, k, term = [math.exp(-mean)], 0, 1.0
    while k < mean or term > 2.0**-60:
        k += 1
        term = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        steps.append(steps[-1] + term)
    return steps


def source_rates(docs: DataFrame, source: str, text: str, weights: Mapping[str | None, float] | None) -> DataFrame:
    """(source, rate): mean repetitions of a source's documents. A source without weight gets none.

    Without weights all sources aim at equal shares of the bytes. The total stays that of the input.
    """
    spark = docs.sparkSession
    bytes_of = docs.groupBy(F.col(source).cast("string").alias("_source")).agg(
        F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint") + 1).alias("_bytes")
    )
    bytes_of = materialize(bytes_of, "sources")
    total = bytes_of.agg(F.sum("_bytes"), F.count(F.lit(1))).first()
    if weights is None:
        weight = bytes_of.withColumn("_weight", F.lit(1.0 / max(total[1], 1)))
    else:
        if any(not (0 <= w < math.inf) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = sum(weights.values()) or 1.0
        listed = spark.createDataFrame([(k, float(w) / given) for k, w in weights.items()], "_key string, _weight double")
        weight = bytes_of.join(listed, F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key").na.fill(0.0, ["_weight"])
    return weight.select("_source", (F.col("_weight") * F.lit(float(total[0] or 0)) / F.col("_bytes")).alias("_rate"))


def poisson_mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    seed: str = SEED,
) -> DataFrame:
    """All columns of `docs` once per repetition, plus `_copy` (from 1) and `_order`, globally shuffled.

    Columns of `docs` with the new names are replaced.

    A null source is a source of its own; null texts weigh one byte, as the line end that every text has.
    Rows with equal ids get equal counts, and a null id counts as the text "null". An empty table gives no rows.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # once per source, not per document
        for batch in batches:
            found = [poisson_steps(r) if r > 0 else [1.0] for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["_source", "_steps"])

    rates = source_rates(docs, source, text, weights).mapInArrow(steps, "_source string, _steps array<double>")
    rates = materialize(rates, "rates")
    docs = docs.drop("_copy", "_order")
    key = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    drawn = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.col(source).cast("string").alias("own"), uniform(F.lit(seed), key).alias("u"))
    drawn = drawn.join(rates, F.col("own").eqNullSafe(F.col("_source")), "inner")
    count = F.size(F.filter("_steps", lambda step: step < F.col("u")))
    copies = drawn.withColumn("count", count).filter("count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    order = uniform(F.lit(seed), F.lit("order"), F.col("key"), F.col("copy").cast("string"))
    return copies.select("doc.*", F.col("copy").alias("_copy"), order.alias("_order")).repartition("_order").sortWithinPartitions("_order")
