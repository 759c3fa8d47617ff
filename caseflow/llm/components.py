"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.scale import materialize


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    Each round rewires the edges towards smaller nodes and writes them to the shared folder; the number of
    rounds grows with the logarithm of the longest path. Self-edges and edges with a null end are ignored.
    """
    now = materialize(
        edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = materialize(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "small")
