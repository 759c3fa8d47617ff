"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Texts never move: rows carry a size and a digest. Groups that hold over 1/`HEAVY` of all bytes (fewer than
`HEAVY` of them can exist) stand alone; all other groups fall by their digest into `BUNDLES` bundles. These at most
HEAVY + BUNDLES units, whatever the size of the input, are differenced: every unit starts as a partial
partition with one filled shard; the two partial partitions with the largest spread are combined, the
fullest shards of one with the emptiest of the other, until one partition is left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.scale import materialize

HEAVY, BUNDLES = 1024, 8192
# Rows of a shard that one task sorts to number them.
PART_ROWS = 1 << 18


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of every unit. Partial partitions list their shards by falling size."""
    if not sizes:
        return []
    nodes: list[tuple] = [()] * len(sizes)  # of a combination: left, right, and the order of its shards after the sum
    heap = [(-size, i, (size, *[0] * (shards - 1))) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=lambda i: -sums[i])
        nodes.append((left, right, order))
        total = tuple(sums[i] for i in order)
        heapq.heappush(heap, (total[-1] - total[0], len(nodes) - 1, total))
    found, todo = [0] * len(sizes), [(len(nodes) - 1, list(range(shards)))]
    while todo:
        node, shard_at = todo.pop()
        if not nodes[node]:
            found[node] = shard_at[0]
            continue
        left, right, order = nodes[node]
        placed = [0] * shards
        for place, i in enumerate(order):
            placed[i] = shard_at[place]
        todo += [(left, placed), (right, placed[::-1])]
    return found


def shard(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """All columns of `docs` but the text are narrowed to (id, size, text_crc32, digest, shard, slot).

    size is the UTF-8 length of the text plus 1 and shards are near equal in bytes; equal texts share a
    shard. slot numbers a shard's rows from 0 without gaps, in an order that a hash of the id decides.
    A null text counts as the empty one. An empty table gives no rows; a repeated row gets its own slot.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id).cast("bigint").alias("id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(body.cast("binary"))).alias("digest"),
    )
    rows = materialize(rows, "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    heavy = F.col("bytes") * HEAVY > (total[0] or 0)
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES))
    groups = groups.select("digest", "bytes", F.when(heavy, F.hex("digest")).otherwise(bundle.cast("string")).alias("unit"))
    groups = materialize(groups, "groups")
    units = groups.groupBy("unit").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "unit").collect()  # < HEAVY + BUNDLES rows
    found = differencing([u["bytes"] for u in units], shards)
    table = spark.createDataFrame([(u["unit"], s) for u, s in zip(units, found, strict=True)], "unit string, shard int")
    placed = rows.join(groups.join(F.broadcast(table), "unit").select("digest", "shard"), "digest")  # bounded as units
    parts = (total[1] or 0) // (PART_ROWS * shards) + 1
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)))
    placed = materialize(placed, "placed")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(F.xxhash64("id"), "id", "digest"))
    return placed.join(offsets, ["shard", "_part"]).select(
        "id", "size", "text_crc32", "digest", "shard", (F.col("_before") + local - 1).cast("bigint").alias("slot")
    )
