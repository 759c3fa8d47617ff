"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Two scans precede the count. Every window of `width` words holds a smallest hash among its sub-windows of
`anchor` words, and equal windows hold the same one; the first scan counts these anchors (about a fifth of
the windows) by document. Windows whose anchor occurs in one document only cannot repeat. The second scan
emits the hashes of all other windows, which Spark counts exactly; repeated windows merge into maximal
removal intervals. The anchors reach the second scan as a Bloom filter, so nothing is lost by its size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import filters
from caseflow.llm.textblocks import NOT_SPACE, SAME, blocks, mix, rolling, window_starts, words
from caseflow.scale import materialize

WIDTH, ANCHOR = 13, 6
_SECOND_BASE = 0xD1342543DE82EF95


def _anchors(w, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside a row, and the smallest anchor hash of each."""
    starts = np.flatnonzero(window_starts(w, width))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    subs = mix(rolling(w.hashes, anchor))
    least = subs[starts]
    for j in range(1, width - anchor + 1):
        np.minimum(least, subs[starts + j], out=least)
    return starts, least


def repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Windows that also start in a document with a smaller id: (id, crc, start) with start in words from 0.

    `crc` tells different texts under one id apart. Rows without an id neither remove nor lose words.
    """
    if not 0 < anchor <= width:
        raise ValueError("anchor must be between 1 and width")
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter("id IS NOT NULL")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                w = words(block, NOT_SPACE, SAME)
                starts, least = _anchors(w, width, anchor)
                rows = w.row_of()[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), pa.array(ids[block.lo + rows[new]])], ["anchor", "id"])

    shared = (
        source.mapInArrow(anchors, "anchor bigint, id bigint")
        .groupBy("anchor")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        .filter("lo < hi")
        .select("anchor")
    )
    known = spark.sparkContext.broadcast(filters.build(materialize(shared, "anchors"), "anchor"))  # at most 16 MB

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                w = words(block, NOT_SPACE, SAME)
                starts, least = _anchors(w, width, anchor)
                starts = starts[filters.passes(known.value, least)]
                if not len(starts):
                    continue
                rows = w.row_of()[starts]
                crcs = np.zeros(len(block.bounds) - 1, np.int64)
                for r in np.unique(rows):
                    crcs[r] = zlib.crc32(block.data[block.bounds[r] : block.bounds[r + 1]])
                one = rolling(w.hashes, width)[starts].view(np.int64)
                two = (rolling(mix(w.hashes), width, _SECOND_BASE)[starts] >> np.uint64(32)).astype(np.int64)
                out = [one, two, ids[block.lo + rows], crcs[rows], (starts - w.bounds[rows]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["one", "two", "id", "crc", "start"])

    found = source.mapInArrow(windows, "one bigint, two bigint, id bigint, crc bigint, start int")
    # The scan runs again for the join: reading the texts once more is cheaper than keeping the windows.
    first = found.groupBy("one", "two").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi")
    # Written, so that the join has an exchange on either side and its hot windows can be split.
    first = materialize(first, "repeated")
    return found.join(first, ["one", "two"]).filter("id > lo").select("id", "crc", "start")


def removal_intervals(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Maximal removal intervals per text: (id, crc, spans array<struct<start, end>>) in words, end exclusive."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column(2).to_pylist():
                s = np.unique(np.asarray(starts, np.int64))
                cut = np.flatnonzero(np.diff(s) > width)
                lows, highs = s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])] + width
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lows, highs, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], ["id", "crc", "spans"])

    starts = repeated_windows(docs, id, text, width).groupBy("id", "crc").agg(F.collect_set("start").alias("starts"))
    return starts.mapInArrow(merge, "id bigint, crc bigint, spans array<struct<start:int,end:int>>")


def _kept(body: bytes, spans) -> tuple[int, int, bytes]:
    """Word count, removed words, and the kept words joined by one space."""
    tokens = body.split()  # splits bytes at 0x20 and 0x09-0x0D
    kept, at, gone = [], 0, 0
    for span in spans or ():
        kept += tokens[at : span["start"]]
        at = span["end"]
        gone += span["end"] - span["start"]
    return len(tokens), gone, b" ".join(kept + tokens[at:])


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Every row with (id, n_words, n_removed, spans, kept): kept is its remaining text, spans the removed words.

    Null and empty texts have no words and an empty kept text. Rows with a null id are kept whole. Texts
    shorter than `width` words are never touched. Repeated rows (same id and text) lose the same words.
    """
    spark = docs.sparkSession
    gone = materialize(removal_intervals(docs, id, text, width), "intervals")
    touched = spark.sparkContext.broadcast(filters.build(gone.select(F.xxhash64("id").alias("h")), "h"))  # at most 16 MB
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    hashed = source.withColumn("h", F.xxhash64("id"))
    result = "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rows(ids, bodies, spans) -> pa.RecordBatch:
        done = [_kept(b.encode(), s) for b, s in zip(bodies, spans, strict=True)]
        out = [ids, pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())]
        out += [pa.array([s or [] for s in spans], kind), pa.array([x[2].decode() for x in done], pa.string())]
        return pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_removed", "spans", "kept"])

    def split(batch: pa.RecordBatch, hit: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(filters.passes(touched.value, batch.column(2).to_numpy()) == hit))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = split(batch, False)
            bodies = [x or "" for x in batch.column(1).to_pylist()]
            yield rows(batch.column(0), bodies, [None] * len(bodies))

    def affected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = split(batch, True)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            crcs = pa.array([zlib.crc32(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), crcs, pa.array(texts, pa.string())], ["id", "crc", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    hit = hashed.mapInArrow(affected, "id bigint, crc bigint, text string").join(gone, ["id", "crc"], "left")
    return hashed.mapInArrow(whole, result).unionByName(hit.select("id", "text", "spans").mapInArrow(cut, result))


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
