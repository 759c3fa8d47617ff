"""Hard negatives by angular triangle filtering.

Vectors become integers, and every row stores its angles to a few reference directions. For an anchor and a row the
triangle inequality on the sphere gives an interval of their angle from each reference; the intersection, as a cosine
times both norms and widened by more than the rounding error, bounds their integer product. Rows lie in packed blocks
of one label around one reference, with the extremes of their angles, so that whole blocks are passed over first and
single rows next. Only rows whose interval meets the window that an anchor still looks for are multiplied.

The anchors are a query set that comes in blocks of bounded size; each takes one pass for the positives and one for
the negatives over all packed rows, in parallel. No group of rows meets in one task, so a hot label is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.llm.ann import kmeans
from caseflow.scale import materialize, spread

# Reference directions, fitted on at most 2 * SAMPLE rows.
REFERENCES, SAMPLE = 16, 4096
BLOCK_BYTES = 1 << 20
# Anchor components per block of the query set (16 MB as doubles), and anchors compared at once.
ANCHOR_CELLS, TOGETHER = 1 << 21, 256
# Angles are stored in 32 bits; the margin covers that and the rounding of cosines and norms.
MARGIN, RELATIVE = 1e-5, 1e-9
EXACT = 1 << 53
SATURATED = (1 << 31) - 1
PACKED = "label string, dims int, ids binary, values binary, angles binary"


class Rows(NamedTuple):
    """Vectors of one length: ids, integer components, norms, and angles to the references."""

    ids: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    angles: np.ndarray


class Anchors(NamedTuple):
    """A block of anchors, by vector length; `labels` and `places` (row of the state tables) go with `rows`."""

    rows: list[Rows]
    labels: list[np.ndarray]
    places: list[np.ndarray]
    n: int


def angles_to(values: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles between rows and unit references; missing components are 0, and zero vectors are at right angles."""
    dims = min(values.shape[1], references.shape[1])
    cosines = values[:, :dims] @ references[:, :dims].T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def angle_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle between anchors (rows of a) and rows whose reference angles lie in low..high."""
    least = np.zeros((len(a), len(low)))
    greatest = np.full((len(a), len(low)), np.pi)
    for r in range(a.shape[1]):
        own, lo, hi = a[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(least, own - hi, out=least)
        np.maximum(least, lo - own, out=least)
        np.minimum(greatest, own + hi, out=greatest)
        np.minimum(greatest, 2 * np.pi - own - lo, out=greatest)
    return np.clip(least - MARGIN, 0, np.pi), np.clip(greatest + MARGIN, 0, np.pi)


def score_bounds(least: np.ndarray, greatest: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the integer product from angle bounds and the norms of both sides (rows between low and high)."""
    top, bottom = np.cos(least) * norms[:, None], np.cos(greatest) * norms[:, None]
    upper, lower = np.where(top > 0, top * high, top * low), np.where(bottom > 0, bottom * low, bottom * high)
    return lower - np.abs(lower) * RELATIVE - 1, upper + np.abs(upper) * RELATIVE + 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where they are exact, else in Python integers."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if dims * int(np.abs(a).max()) * int(np.abs(b).max()) < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Order of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best (score, id) of every slot so far."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * slots
        self.least: list[int | None] = [None] * slots

    def add(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old, old_ids = self.held[slot]
        scores, ids = np.concatenate([old, scores]), np.concatenate([old_ids, ids])
        order = _top(scores, ids, self.k)
        self.held[slot] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[slot] = int(scores[order[-1]])

    def table(self, slots: list[tuple]) -> Iterator[tuple]:
        for own, (scores, ids) in zip(slots, self.held, strict=True):
            for score, found in zip(scores.tolist(), ids.tolist(), strict=True):
                yield *own, found, score


def unpack(row: dict) -> Rows:
    ids = np.frombuffer(row["ids"], np.int64)
    values = np.frombuffer(row["values"], np.int32).reshape(len(ids), row["dims"]).astype(np.float64)
    return Rows(ids, values, np.sqrt((values**2).sum(1)), np.frombuffer(row["angles"], np.float32).reshape(len(ids), -1))


def windowed(anchors: Rows, rows: Rows, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exact products where an anchor's window low..high can hold a row: (anchor position, row position, score)."""
    edges = rows.angles.min(0)[None], rows.angles.max(0)[None]
    norms = np.array([rows.norms.min()]), np.array([rows.norms.max()])
    under, over = score_bounds(*angle_bounds(anchors.angles, *edges), anchors.norms, *norms)
    meets = np.flatnonzero((over[:, 0] >= low) & (under[:, 0] <= high))
    for at in range(0, len(meets), TOGETHER):
        some = meets[at : at + TOGETHER]
        under, over = score_bounds(*angle_bounds(anchors.angles[some], rows.angles, rows.angles), anchors.norms[some], rows.norms, rows.norms)
        asked = (over >= low[some, None]) & (under <= high[some, None])
        asked &= anchors.ids[some, None] != rows.ids[None]
        columns = np.flatnonzero(asked.any(0))
        if not len(columns):
            continue
        scores = products(anchors.values[some], rows.values[columns])
        own, row = np.nonzero(asked[:, columns])
        yield some[own], columns[row], scores[own, row]


def add_positives(anchors: Rows, places: np.ndarray, rows: Rows, best: Best) -> None:
    low = np.array([-np.inf if best.least[p] is None else float(best.least[p]) for p in places])
    for own, row, scores in windowed(anchors, rows, low, np.full(len(places), np.inf)):
        for at in _runs(own):
            best.add(places[own[at.start]], scores[at], rows.ids[row[at]])


def _runs(sorted_values: np.ndarray) -> list[slice]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(sorted_values)], strict=True)] if len(sorted_values) else []


def add_negatives(anchors: Rows, places: np.ndarray, rows: Rows, positives: list[list[int]], slots: list[list[int]], best: Best, low_part: int, part: int) -> None:
    """Negatives per positive: low_part * positive <= part * score <= part * positive, scores in Python or 64-bit integers."""
    low, high = np.full(len(places), np.inf), np.full(len(places), -np.inf)
    for i, place in enumerate(places):
        for positive, slot in zip(positives[place], slots[place], strict=True):
            floor = -(-low_part * positive // part)
            floor = floor if best.least[slot] is None else max(floor, best.least[slot])
            if floor <= positive:
                low[i], high[i] = min(low[i], float(floor)), max(high[i], float(positive))
    for own, row, scores in windowed(anchors, rows, low, high):
        for at in _runs(own):
            place = places[own[at.start]]
            mine, ids = scores[at], rows.ids[row[at]]
            for positive, slot in zip(positives[place], slots[place], strict=True):
                fits = (part * mine <= part * positive) & (part * mine >= low_part * positive)
                if best.least[slot] is not None:
                    fits &= mine >= best.least[slot]
                if fits.any():
                    best.add(slot, mine[fits.astype(bool)], ids[fits.astype(bool)])


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.clip(np.floor(scale * flat), -SATURATED, SATURATED)


def _by_length(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integer matrix) of vectors of one length each."""
    lengths = np.diff(column.offsets.to_numpy())
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        yield at, _matrix(column.take(pa.array(at)), scale) if dims else np.zeros((len(at), 0))


def _references(rows: DataFrame, scale: int, total: int) -> np.ndarray:
    """Unit directions of k-means centroids over a bounded sample of the most common length."""
    share = int(min(1.0, SAMPLE / total) * (1 << 30))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share).limit(2 * SAMPLE).select("v").toArrow()["v"].combine_chunks()
    best = max((m for _, m in _by_length(chosen, scale)), key=len, default=np.zeros((0, 0))) if len(chosen) else np.zeros((0, 0))
    norms = np.sqrt((best**2).sum(1))
    units = best[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.ones((1, 1))
    centres = kmeans(units, REFERENCES)
    norms = np.sqrt((centres**2).sum(1))
    return centres[norms > 0] / norms[norms > 0][:, None] if (norms > 0).any() else units[:1]


def mine(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    scale: int = 256,
    low_part: int = 80,
    part: int = 100,
    anchor_cells: int = ANCHOR_CELLS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each id divisible by `every`.

    Components become floor(scale * x); a score is the integer product with the anchor, higher first, ties to smaller
    ids. Positives are an anchor's best other rows of its label; per positive the best rows of other labels with
    low_part * positive <= part * negative <= part * positive are returned.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Zero and empty vectors score
    0 with everything; of vectors of different length the longer one's excess meets zeros. Of several rows under one
    id the smallest by label and vector stays, so repeated rows count once. Components saturate at 32 bits and
    scores at 64. Anchors without positives, and positives without negatives in their window, return no rows, as do empty tables.
    """
    spark = vectors.sparkSession
    form = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_r")).select("id", "_r.label", "_r.v"), "rows")
    total, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], form)
    references = spark.sparkContext.broadcast(_references(rows, scale, total))  # REFERENCES vectors

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _by_length(batch.column(2), scale):
                turned = angles_to(values, np.sqrt((values**2).sum(1)), references.value)
                ids, labels = (batch.column(c).take(pa.array(at)) for c in (0, 1))
                cells = [
                    ids,
                    labels,
                    pa.array(np.full(len(at), values.shape[1]), pa.int32()),
                    pa.array(turned.argmin(1), pa.int32()),
                    pa.array([v.tobytes() for v in values.astype(np.int32)], pa.binary()),
                    pa.array([a.tobytes() for a in turned], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["id", "label", "dims", "cell", "values", "angles"])

    measured = materialize(rows.mapInArrow(measure, "id bigint, label string, dims int, cell int, values binary, angles binary"), "measured")
    group = ["label", "dims", "cell"]
    sizes = measured.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.col("dims"), F.lit(8)) * 4 / BLOCK_BYTES).cast("int").alias("_parts"))
    sizes = materialize(sizes, "sizes")  # so that rows need not meet by group before they are dealt

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        joined = [b"".join(table[c].to_pylist()) for c in ("values", "angles")]
        return pa.table(
            {
                "label": table["label"][:1],
                "dims": table["dims"][:1],
                "ids": pa.array([table["id"].to_numpy().tobytes()], pa.binary()),
                "values": pa.array(joined[:1], pa.binary()),
                "angles": pa.array(joined[1:], pa.binary()),
            }
        )

    placed = measured.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).repartition(*group, "_part")
    packed = spread(materialize(placed.groupBy(*group, "_part").applyInArrow(pack, PACKED), "packed"))

    anchors = measured.filter(F.col("id") % every == 0)
    n_blocks = max(1, -(-anchors.count() * max(longest, 1) // anchor_cells))
    anchors = anchors.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    parts = []
    for number in range(n_blocks):
        asked = anchors.filter(F.col("_block") == number).select("id", "label", "dims", "values", "angles").toArrow()  # one block of the query set
        if len(asked):
            parts.append(_mine_block(packed, asked, positives, negatives, low_part, part))
    if not parts:
        return spark.createDataFrame([], form)
    found = parts[0]
    for block in parts[1:]:
        found = found.unionByName(block)
    return found


def _anchors(asked: pa.Table) -> tuple[list[int], Anchors]:
    asked = asked.sort_by("id").combine_chunks()
    dims, labels = asked["dims"].to_numpy(), np.array(asked["label"].to_pylist(), object)
    rows, own_labels, places = [], [], []
    for length in np.unique(dims):
        at = np.flatnonzero(dims == length)
        part = asked.take(pa.array(at))
        joined = {c: b"".join(part[c].to_pylist()) for c in ("values", "angles")}
        rows.append(unpack({"ids": part["id"].to_numpy().tobytes(), "dims": int(length), **joined}))
        own_labels.append(labels[at])
        places.append(at)
    return asked["id"].to_pylist(), Anchors(rows, own_labels, places, len(asked))


def _scan(packed: DataFrame, form: str, start: Callable[[], tuple[Best, list[tuple]]], use: Callable[[Best, str, Rows], None]) -> DataFrame:
    """Walk all packed blocks with one running state per task, and return what it holds in the end."""
    names = [field.split()[0] for field in form.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, slots = start()
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                use(best, row["label"], unpack(row))
        limit = np.iinfo(np.int64)
        found = list(best.table(slots))
        if found:
            columns = [[min(max(v, limit.min), limit.max) for v in column] for column in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return packed.mapInArrow(run, form)


def _mine_block(packed: DataFrame, asked: pa.Table, positives: int, negatives: int, low_part: int, part: int) -> DataFrame:
    spark = packed.sparkSession
    ids, anchors = _anchors(asked)
    sent = spark.sparkContext.broadcast((ids, anchors))  # ANCHOR_CELLS

    def positive_start() -> tuple[Best, list[tuple]]:
        return Best(sent.value[1].n, positives), [(i,) for i in sent.value[0]]

    def positive_use(best: Best, label: str, rows: Rows) -> None:
        known = sent.value[1]
        for own, labels, places in zip(known.rows, known.labels, known.places, strict=True):
            at = np.flatnonzero(labels == label)
            if len(at):
                add_positives(Rows(*(x[at] for x in own)), places[at], rows, best)

    near = _scan(packed, "anchor_id bigint, positive_id bigint, positive_score bigint", positive_start, positive_use)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = materialize(near.withColumn("_rank", rank).filter(F.col("_rank") <= positives).drop("_rank"), "positives")
    chosen = near.toArrow().sort_by([("anchor_id", "ascending"), ("positive_id", "ascending")])  # `positives` rows per anchor of the block
    place = {a: i for i, a in enumerate(ids)}
    slots = list(zip(*(chosen[c].to_pylist() for c in ("anchor_id", "positive_id", "positive_score")), strict=True))
    scores: list[list[int]] = [[] for _ in ids]
    numbers: list[list[int]] = [[] for _ in ids]
    for slot, (anchor, _, score) in enumerate(slots):
        scores[place[anchor]].append(score)
        numbers[place[anchor]].append(slot)
    told = spark.sparkContext.broadcast((slots, scores, numbers))

    def negative_start() -> tuple[Best, list[tuple]]:
        return Best(len(told.value[0]), negatives), told.value[0]

    def negative_use(best: Best, label: str, rows: Rows) -> None:
        known, (_, scores, numbers) = sent.value[1], told.value
        for own, labels, places in zip(known.rows, known.labels, known.places, strict=True):
            at = np.flatnonzero(labels != label)
            if len(at):
                add_negatives(Rows(*(x[at] for x in own)), places[at], rows, scores, numbers, best, low_part, part)

    form = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    far = _scan(packed, form, negative_start, negative_use)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    far = materialize(far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    sent.destroy()
    told.destroy()
    return far
