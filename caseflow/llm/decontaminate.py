"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside a task. Its words become the ids of benchmark words; stretches of other words
cannot take part in a phrase and shrink to one break each, as do stretches shorter than any phrase. Over what is left
the shard's suffix array gives the Burrows-Wheeler transform, a wavelet matrix answers its ranks, and all phrases
are searched backward at once. Occurrences are located by walking to suffixes sampled every `SAMPLE` positions;
their words merge into maximal removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.textblocks import ALNUM, LOWER, blocks, release, words

WIDTH, SAMPLE = 13, 8
# Benchmark text per pass; larger benchmarks take more passes over the documents.
PART_BYTES = 16 << 20
# Text bytes per shard.
SHARD_BYTES = 1 << 20


class Phrases:
    """Distinct windows of benchmark items as word ids, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        column = pa.array([text for _, text in items], pa.string())
        runs: list[np.ndarray] = []
        owners: list[int] = []
        for block in blocks(column):
            w = words(block, ALNUM, LOWER)
            for r in range(block.hi - block.lo):
                own = w.hashes[w.bounds[r] : w.bounds[r + 1]]
                for i in range(max(len(own) - width + 1, min(len(own), 1))):
                    runs.append(own[i : i + width])
                    owners.append(items[block.lo + r][0])
        self.vocabulary = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        places: dict[bytes, int] = {}
        self.phrases: list[np.ndarray] = []
        self.owners: list[set[int]] = []
        for run, owner in zip(runs, owners, strict=True):
            at = places.setdefault(run.tobytes(), len(places))
            if at == len(self.phrases):
                self.phrases.append(np.searchsorted(self.vocabulary, run) + 1)
                self.owners.append(set())
            self.owners[at].add(owner)
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)
        self.table = np.zeros((len(self.phrases), width), np.int64)  # aligned right
        for i, p in enumerate(self.phrases):
            self.table[i, width - len(p) :] = p

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids from 1; 0 for words of no phrase."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


class FMIndex:
    """Suffix order of a sequence of ids over 0; every 0 is a break that no phrase crosses."""

    def __init__(self, text: np.ndarray, depth: int, sample: int = SAMPLE):
        """`depth`: the longest phrase; suffixes are ordered by that many ids and then by position."""
        n = len(text)
        self.n, self.sample = n, sample
        # The rank of a suffix by its first 1, 2, 4 ... ids. LF-steps need the full order, so doubling
        # runs until all ranks differ; breaks are made different, which ends it early.
        breaks = np.cumsum(text == 0)
        first = np.where(text == 0, breaks, text + breaks[-1])
        rank, length = np.unique(first, return_inverse=True)[1].astype(np.int64), 1
        while True:
            later = np.zeros(n, np.int64)
            later[: n - length] = rank[length:] + 1
            key = rank * (n + 2) + later
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            step = np.zeros(n, np.int64)
            step[1:] = np.cumsum(ordered[1:] != ordered[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            length *= 2
        self.last = text[order - 1]
        self.levels = max(int(text.max()).bit_length(), 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.levels)))])
        # Suffixes behind a break are sampled too: a walk to the left never crosses one.
        self.sampled = np.flatnonzero((order % sample == 0) | (self.last == 0))
        self.position = order[self.sampled]
        self.ones, self.zeros = [], []
        row = self.last
        for level in reversed(range(self.levels)):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `end` ids of the transform."""
        lo, hi = np.zeros(len(end), np.int64), end.astype(np.int64)
        for i, level in enumerate(reversed(range(self.levels))):
            ones, bit = self.ones[i], (symbol >> level) & 1
            a, b = ones[lo], ones[hi]
            lo = np.where(bit == 1, self.zeros[i] + a, lo - a)
            hi = np.where(bit == 1, self.zeros[i] + b, hi - b)
        return hi - lo

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases that stand right-aligned in `table`."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        top = (1 << self.levels) - 1
        for step in range(1, table.shape[1] + 1):
            symbol = table[:, -step]
            live = np.flatnonzero((lengths >= step) & (hi > lo))
            if not len(live):
                break
            known = symbol[live] <= top
            hi[live[~known]] = lo[live[~known]]
            live = live[known]
            s = symbol[live]
            lo[live] = self.before[s] + self.rank(s, lo[live])
            hi[live] = self.before[s] + self.rank(s, hi[live])
        return lo, hi

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the left until a sampled one is met."""
        found, at, walked = np.full(len(suffixes), -1, np.int64), suffixes.copy(), 0
        todo = np.arange(len(suffixes))
        while len(todo):
            place = np.searchsorted(self.sampled, at[todo])
            hit = (place < len(self.sampled)) & (self.sampled[np.minimum(place, len(self.sampled) - 1)] == at[todo])
            found[todo[hit]] = self.position[place[hit]] + walked
            todo = todo[~hit]
            if len(todo):
                symbol = self.last[at[todo]]
                at[todo] = self.before[symbol] + self.rank(symbol, at[todo])
            walked += 1
        return found


def _stretches(ids: np.ndarray, row_end: np.ndarray, shortest: int) -> np.ndarray:
    """Mask of words in stretches of at least `shortest` benchmark words within a row."""
    n = len(ids)
    inside = ids > 0
    start = inside.copy()
    start[1:] &= ~inside[:-1] | (row_end[1:] != row_end[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (row_end[1:] != row_end[:-1])
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    keep = b - a >= shortest
    delta = np.zeros(n + 1, np.int64)
    delta[a[keep]] += 1
    delta[b[keep]] -= 1
    return np.cumsum(delta[:-1]) > 0


def shard_hits(phrases: Phrases, w, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a shard of words: (phrase, word position)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(w.hashes):
        return none
    row_end = w.row_end()
    ids = phrases.ids(w.hashes)
    place = np.flatnonzero(_stretches(ids, row_end, int(phrases.lengths.min())))
    if not len(place):
        return none
    # A break before every stretch (a gap in the positions or a new row), and one at the end.
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (row_end[place[1:]] != row_end[place[:-1]])
    at = np.arange(len(place)) + np.cumsum(new)
    text = np.zeros(int(at[-1]) + 2, np.int64)
    text[at] = ids[place]
    origin = np.zeros(len(text), np.int64)
    origin[at] = place
    index = FMIndex(text, phrases.table.shape[1], sample)
    lo, hi = index.search(phrases.table, phrases.lengths)
    which = np.repeat(np.arange(len(lo)), np.maximum(hi - lo, 0))
    inside = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), np.maximum(hi - lo, 0))
    return which, origin[index.locate(lo[which] + inside)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(starts) - 1]])
    return [{"start": int(starts[a]), "end": int(ends[b])} for a, b in zip(first, last, strict=True)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH
) -> DataFrame:
    """All columns and rows of `docs` plus `_n_words`, `_spans` and `_items`.

    Words are runs of a-z, 0-9 and bytes over 0x7F after lower-casing A-Z. A phrase is `width` consecutive words of an
    item, or all words of a shorter one. _spans are the maximal runs of document words inside occurrences
    (word positions, end exclusive), _items the sorted ids, as strings, of the items that occur. Null texts and items
    have no words. Repeated rows repeat in the result. Equal items under several ids are all listed. Columns of `docs`
    with the new names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("_n_words", "_spans", "_items")
    given = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).filter(
        "text IS NOT NULL AND item IS NOT NULL"
    )
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // PART_BYTES) + 1
    found = docs.select(
        "*",
        F.lit(0).cast("bigint").alias("_n_words"),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("_spans"),
        F.expr("CAST(array() AS array<string>)").alias("_items"),
    )
    body, schema = docs.columns.index(text), found.schema
    for part in range(parts):
        rows = given.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()  # about PART_BYTES of text
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows], width))

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = phrases.value
                for block in blocks(batch.column(body), SHARD_BYTES):
                    w = words(block, ALNUM, LOWER)
                    rows = batch.slice(block.lo, block.hi - block.lo)
                    which, at = shard_hits(known, w)
                    spans, items = rows.column(-2).to_pylist(), rows.column(-1).to_pylist()
                    row = np.searchsorted(w.bounds, at, "right") - 1
                    order = np.argsort(row, kind="stable")
                    cuts = np.flatnonzero(np.diff(row[order])) + 1
                    for own in np.split(order, cuts) if len(order) else ():
                        r = int(row[own[0]])
                        starts = at[own] - w.bounds[r]
                        old = spans[r]
                        starts_all = np.concatenate([starts, [s["start"] for s in old]]).astype(np.int64)
                        ends_all = np.concatenate([starts + known.lengths[which[own]], [s["end"] for s in old]]).astype(np.int64)
                        spans[r] = _merge(starts_all, ends_all)
                        items[r] = sorted(set(items[r]).union(*(known.owners[p] for p in np.unique(which[own]))))
                    new = [pa.array(np.diff(w.bounds)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-3], *new], batch.schema.names)
            release()

        found = found.mapInArrow(search, schema)
    return found


def digests(found: DataFrame) -> DataFrame:
    """find_contamination() with `_n_hit` and `_contaminated`: at least a twentieth of the words are hit."""
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.withColumn("_n_hit", hit).withColumn("_contaminated", F.expr("_n_hit > 0 AND 20 * _n_hit >= _n_words"))
