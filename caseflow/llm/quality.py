"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are words (lower-cased runs of a-z, 0-9 and bytes over 0x7F) and every other visible byte. They fall by hash
into `BUCKETS` buckets, each with a sparse random index vector. A bucket's context vector is the sum of the index
vectors of its neighbours, at most two tokens away, over all documents; Spark adds the tables of its tasks. A text
is the mean and the spread of its tokens' context vectors and its length. The network is
trained with numpy on a bounded sample of labelled rows; a temperature fitted on rows it has not seen calibrates
its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.textblocks import ALNUM, LOWER, Block, blocks, release, words
from caseflow.scale import materialize

BUCKETS, DIMS, NONZERO, REACH = 8192, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 128, 0.003, 1e-4
TRAIN_DOCS = 12_000
SEED = 4
# Text bytes counted at once, and pooled at once, where every token takes a few rows of DIMS floats.
TOKEN_BYTES, POOL_BYTES = 1 << 19, 1 << 17

# Visible bytes that are no part of words.
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = ~ALNUM[LOWER[0x21:0x7F]]


class Model(NamedTuple):
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token, and the token bounds of every row."""
    w = words(block, ALNUM, LOWER)
    marks = np.flatnonzero(_MARK[block.data])
    place = np.concatenate([w.start, marks])
    bucket = np.concatenate([(w.hashes % np.uint64(BUCKETS - 256)).astype(np.int64) + 256, block.data[marks].astype(np.int64)])
    order = np.argsort(place, kind="stable")
    return bucket[order], np.searchsorted(place[order], block.bounds)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of every bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMS)), 1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def add_contexts(table: np.ndarray, bucket: np.ndarray, bounds: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the neighbours' index vectors to the table (BUCKETS x DIMS, flat)."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for away in range(1, REACH + 1):
        same = row[away:] == row[:-away]
        left, right = bucket[:-away][same], bucket[away:][same]
        for own, other in ((left, right), (right, left)):
            for j in range(NONZERO):
                table += np.bincount(own * DIMS + places[other, j], signs[other, j], len(table))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors of all buckets over all documents; zero for buckets without tokens."""
    source = docs.select(F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        table, seen = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0), TOKEN_BYTES):
                bucket, bounds = tokens(block)
                add_contexts(table, bucket, bounds, places, signs)
                seen += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(seen[used]), pa.array(list(table.reshape(BUCKETS, DIMS)[used].astype(np.int64)), pa.list_(pa.int64()))], ["bucket", "n", "v"]
        )
        del table, seen
        release()

    tables = source.mapInArrow(count, "bucket int, n bigint, v array<bigint>")
    sums = tables.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS))).toArrow()  # BUCKETS rows
    vectors = np.zeros((BUCKETS, DIMS))
    if len(sums):
        at, n = sums["bucket"].to_numpy(), sums["n"].to_numpy().astype(float)
        found = np.column_stack([sums[f"v{i}"].to_numpy() for i in range(DIMS)]).astype(float)
        found = found / n[:, None] - found.sum(0) / n.sum()  # without what all words share
        vectors[at] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return vectors.astype(np.float32)


def pool(vectors: np.ndarray, column: pa.Array) -> np.ndarray:
    """Mean, spread and length features of every text of a column."""
    parts = []
    for block in blocks(column, POOL_BYTES):
        bucket, bounds = tokens(block)
        n = np.diff(bounds)
        mean, spread = np.zeros((len(n), DIMS)), np.zeros((len(n), DIMS))
        if len(bucket):
            own, first = vectors[bucket], bounds[:-1][n > 0]
            mean[n > 0] = np.add.reduceat(own, first, dtype=np.float64) / n[n > 0, None]
            square = np.add.reduceat(own * own, first, dtype=np.float64) / n[n > 0, None]
            spread[n > 0] = np.sqrt(np.maximum(square - mean[n > 0] ** 2, 0))
        parts.append(np.hstack([mean, spread, np.log1p(n)[:, None]]))
    return np.vstack(parts) if parts else np.zeros((0, 2 * DIMS + 1))


def _forward(layers: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the logistic loss."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moment, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            hidden, out = _forward(tuple(layers), x[own])
            error = (_sigmoid(out) - y[own]) / len(own)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [x[own].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], np.array([error.sum()])]
            step += 1
            for p, g, m, s in zip(layers, slopes, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least logistic loss on a fine grid."""
    grid = np.geomspace(0.2, 10, 118)
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(labelled: DataFrame, vectors: np.ndarray, text: str = "text", label: str = "quality", id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on about `train_docs` labelled rows (label 0 or 1), chosen by a hash of the id; equal texts count once.

    A fifth of the texts, by a hash, only calibrates. Rows with a null label are ignored, null texts count as
    empty. With fewer than two labels the model returns the smoothed share of ones.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        F.col(id).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")
    )
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(draw < min(1.0, train_docs / max(rows.count(), 1))).dropDuplicates(["text", "label"])
    chosen = materialize(chosen.select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("aside")), "labelled")
    sent = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIMS floats

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(sent.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["label", "aside", "x"])
        release()

    found = chosen.mapInArrow(measure, "label int, aside boolean, x array<double>").toArrow()  # the bounded sample
    sent.destroy()
    y = found["label"].to_numpy().astype(float)
    x = np.asarray(found["x"].to_pylist()).reshape(len(y), 2 * DIMS + 1)
    order = np.lexsort((*x.T, y))  # the same order on every run
    x, y, aside = x[order], y[order], np.asarray(found["aside"].to_pylist(), bool)[order]
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(2 * DIMS + 1), np.ones(2 * DIMS + 1))
    if len(set(y[~aside])) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        flat = (np.zeros((2 * DIMS + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))]))
        return Model(vectors, center, scale, flat, 1.0)
    x = (x - center) / scale
    layers = fit_network(x[~aside], y[~aside])
    temperature = fit_temperature(_forward(layers, x[aside])[1], y[aside]) if aside.any() else 1.0
    return Model(vectors, center, scale, layers, temperature)


def predict(model: Model, column: pa.Array) -> np.ndarray:
    """Calibrated probability of label 1 for every text of a column."""
    x = (pool(model.vectors, column) - model.center) / model.scale
    return _sigmoid(_forward(model.layers, np.clip(x, -8, 8))[1] / model.temperature)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and rows of `docs` plus `_score` (a column of that name is replaced), for whole texts.

    Null and empty texts count as texts without tokens. Repeated rows repeat in the result.
    """
    docs = docs.drop("_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    body = docs.columns.index(text)
    schema = docs.withColumn("_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predict(sent.value, batch.column(body)))], [*batch.schema.names, "_score"])
        release()

    return docs.mapInArrow(run, schema)
