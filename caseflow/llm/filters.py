"""Bloom filters of 64-bit hashes: a fixed-size, broadcastable superset test in front of exact joins.

A filter never loses a member; what passes by chance is settled by the exact step behind it. Its size
follows the number of members up to `MAX_BITS` (16 MB), which is the proven bound of the broadcast; beyond,
more rows pass and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.textblocks import release
from caseflow.scale import materialize

MIN_BITS, MAX_BITS = 1 << 16, 1 << 27


def build(members: DataFrame, column: str, max_bits: int = MAX_BITS) -> np.ndarray:
    """Filter words of the well-mixed bigint `column`; at most max_bits / 64 rows come to the driver."""
    n = members.count()
    bits = int(min(max_bits, max(MIN_BITS, 1 << (16 * n).bit_length())))
    places = members.select(
        F.explode(F.array(*(F.expr(f"shiftrightunsigned(`{column}`, {s}) & {bits - 1}L") for s in (0, 32)))).alias("_p")
    )
    rows = (
        places.select(F.expr("shiftright(_p, 6)").alias("_w"), F.expr("shiftleft(1L, CAST(_p & 63 AS INT))").alias("_b"))
        .groupBy("_w")
        .agg(F.bit_or("_b").alias("_b"))
        .toArrow()
    )
    filled = np.zeros(bits // 64, np.uint64)
    filled[rows["_w"].to_numpy()] = rows["_b"].to_numpy().view(np.uint64)
    return filled


def passes(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    last = np.uint64(len(filled) * 64 - 1)
    ok = np.ones(len(h), bool)
    for s in (0, 32):
        p = (h >> np.uint64(s)) & last
        ok &= (filled[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


class Held:
    """Filters that are broadcast inside a `with` block and leave all executors at its end.

    What reads them has to be written by then.
    """

    def __init__(self, docs: DataFrame):
        self.context = docs.sparkSession.sparkContext
        self.sent: list[Broadcast] = []

    def __enter__(self) -> Held:
        return self

    def filter(self, members: DataFrame, column: str) -> Broadcast:
        self.sent.append(self.context.broadcast(build(members, column)))  # at most MAX_BITS
        return self.sent[-1]

    def __exit__(self, *_: object) -> None:
        for one in self.sent:
            one.destroy()


def without(docs: DataFrame, gone: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id is not in the single column of `gone`; rows that the filter clears are not shuffled."""
    gone = materialize(gone.select(F.col(gone.columns[0]).cast("bigint").alias("__gone")).filter("__gone IS NOT NULL").distinct(), "gone")
    sent = docs.sparkSession.sparkContext.broadcast(build(gone.select(F.xxhash64("__gone").alias("h")), "h"))  # at most MAX_BITS
    hashed = docs.select("*", F.xxhash64(F.col(id).cast("bigint")).alias("__h"))

    def side(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = passes(sent.value, batch.column(batch.num_columns - 1).to_numpy()) == hit
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(ok)).columns[:-1], batch.schema.names[:-1])
            release()

        return hashed.mapInArrow(run, docs.schema)

    checked = side(True).join(gone, F.col(id).cast("bigint") == F.col("__gone"), "left_anti")
    return side(False).unionByName(checked)
