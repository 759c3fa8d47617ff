"""Approximate nearest neighbours by adaptive dimension scans over probed lists.

Lists come from k-means over a bounded sample; every vector joins the list of its nearest centroid, and lists are
dealt in chunks, so a hot list is many tasks. All vectors are turned by one random rotation. A chunk is scanned in
column blocks: after d of D rotated dimensions the partial distance, scaled to all dimensions, is tested against
the current k-th distance, and candidates that exceed it by more than the sampling error allows are abandoned.
What survives all blocks is measured exactly on the original vectors.

The number of probed lists is calibrated on the sample for the recall asked for: data without clusters need most
lists, clustered data few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.scale import materialize

SAMPLE, MAX_LISTS = 16_384, 4096
CHUNK_ROWS, QUERY_ROWS = 8192, 1024
COLUMNS, ERROR = 16, 2.1
SEED = 20


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, for ranking only."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centroids = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        near = _squares(sample, centroids).argmin(1)
        order = np.argsort(near, kind="stable")
        present, first = np.unique(near[order], return_index=True)
        centroids[present] = np.add.reduceat(sample[order], first) / np.diff(np.append(first, len(sample)))[:, None]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Fewest probed lists that hold `recall` of the sample's true neighbours."""
    if len(sample) <= k:
        return len(centroids)
    asked = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    true = np.argpartition(_squares(asked, sample), k, 1)[:, : k + 1]
    home = _squares(sample, centroids).argmin(1)[true]
    rank = np.argsort(np.argsort(_squares(asked, centroids), 1), 1)
    needed = np.sort(np.take_along_axis(rank, home, 1).ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed) - 1)]) + 1


def adaptive_scan(query: np.ndarray, turned: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, ids: np.ndarray, k: int, step: int = 1024):
    """The k nearest rows of a chunk: (ids, distances), ties to smaller ids. `ids` ascend."""
    dims = vectors.shape[1]
    best_d, best_i = np.zeros(0), np.zeros(0, ids.dtype)
    for at in range(0, len(ids), step):
        alive = np.arange(at, min(at + step, len(ids)))
        partial = np.zeros(len(alive))
        for lo in range(0, dims, COLUMNS):
            hi = min(lo + COLUMNS, dims)
            partial += ((rotated[alive, lo:hi] - turned[lo:hi]) ** 2).sum(1)
            if len(best_d) >= k and hi < dims:
                stay = partial * dims <= hi * (best_d[-1] * (1 + ERROR / np.sqrt(hi))) ** 2 * (1 + 1e-9)
                alive, partial = alive[stay], partial[stay]
        exact = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, exact]), np.concatenate([best_i, ids[alive]])
        top = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[top], best_i[top]
    return best_i, best_d


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, recall: float = 0.97, sample_rows: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` the k nearest other ids found.

    score is the Euclidean distance in double precision on the original vectors; ties go to the smaller id.
    Rows with a null id, and vectors that are null, zero, hold a null or non-finite component or have another
    length than most, take no part. Rows repeated under one id count once, at their smallest distance.
    Equal vectors are ordinary candidates of each other. Without valid vectors the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dims, total = common[0]["dims"], common[0]["count"]
    rows = rows.filter(F.size("v") == dims).dropDuplicates(["id", "v"])

    share = min(1.0, sample_rows / total)
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = _matrix(chosen.limit(2 * sample_rows).toArrow()["v"].combine_chunks())  # at most 2 * sample_rows vectors
    if not len(sample):
        sample = _matrix(rows.limit(sample_rows).toArrow()["v"].combine_chunks())
    centroids = kmeans(sample, max(1, min(MAX_LISTS, round(total**0.5))))
    probes = probes_for(sample, centroids, k, recall)
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]
    model = spark.sparkContext.broadcast((centroids, rotation))  # at most MAX_LISTS vectors and a square of dims

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _squares(_matrix(batch.column(1)), model.value[0]).argmin(1) if len(batch) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], ["list", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                lists = np.argsort(_squares(_matrix(part.column(1)), model.value[0]), 1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(part)), lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.ravel(), pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["list", "id", "v"]
                )

    form = "list int, id bigint, v array<double>"
    placed = materialize(rows.mapInArrow(assign, form), "placed")
    asked = materialize(placed.filter(F.col("id") % every == 0).select("id", "v").mapInArrow(probe, form), "asked")
    loads = placed.groupBy("list").count().select("list", F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    calls = asked.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("parts"))
    cut = materialize(loads.join(calls, "list"), "cut")  # at most MAX_LISTS rows
    cut = F.broadcast(cut)

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        side = side.join(cut, "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).select("list", "chunk", "part", "id", "v")

    data = dealt(placed, "chunk", "chunks", "part", "parts")
    questions = dealt(asked, "part", "parts", "chunk", "chunks")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["id"].to_numpy()
        body = _matrix(right["v"].combine_chunks()) if len(right) else np.zeros((0, dims))
        order = np.argsort(ids, kind="stable")
        ids, body = ids[order], body[order]
        turned = body @ model.value[1]
        queries, found = left["id"].to_numpy(), []
        if len(left) and len(right):
            asked_v = _matrix(left["v"].combine_chunks())
            repeated = int(np.unique(ids, return_counts=True)[1].max())
            for q, v, t in zip(queries, asked_v, asked_v @ model.value[1], strict=True):
                got, far = adaptive_scan(v, t, body, turned, ids, (k + 1) * repeated)
                keep = got != q
                found.append((np.full(keep.sum(), q), got[keep], far[keep]))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    keys = ["list", "chunk", "part"]
    near = questions.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(scan, "query_id bigint, vec_id bigint, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
