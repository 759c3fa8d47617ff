"""Ranked lexical search: MaxScore with bounds of term pairs.

The index is a table of segments. A segment is a run of documents inside a task: their ids and lengths and, for the
terms of the query log, posting lists of document ordinals and counts. Document frequencies and lengths are added up
over all segments, so that every posting has its final integer impact before it is searched.

Queries come in blocks. For a block a segment gets the highest impact of each term and, for each pair of terms that a
query uses, the intersection list of the two with the highest joint impact. A query is a set of disjoint pairs: what
a pair can add to a document is the larger of its joint maximum and its single maxima, which is far less than their
sum where rare terms do not meet. MaxScore then runs over pairs: the pairs whose bounds together stay below the k-th
score so far open no document, a pair that is only strong jointly opens its intersection alone, and documents leave
when their score plus the bounds still open falls below that score. Nothing that could reach the top k is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.llm import filters
from caseflow.llm.textblocks import ALNUM, LOWER, blocks, words
from caseflow.scale import materialize

# Text bytes per segment.
SEGMENT_BYTES = 8 << 20
# Query terms per block: what the driver collects and broadcasts at once, and one pass over the index.
BLOCK_TERMS = 1 << 18
SEGMENTS = "docs bigint, terms bigint, ids binary, lengths binary, vocabulary binary, counts binary, ordinals binary, tf binary"
LARGEST = np.iinfo(np.int64).max


class Queries(NamedTuple):
    """A block of queries: sorted terms with their weights, and the term numbers of each query, best weight first."""

    ids: list[int]
    terms: np.ndarray
    weights: np.ndarray
    members: list[np.ndarray]


class Segment:
    """Impacts of a segment for the terms of a block, with term and pair maxima."""

    def __init__(self, row: dict[str, bytes], queries: Queries, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int64))])
        at = np.searchsorted(vocabulary, queries.terms)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == queries.terms[known]
        sizes = np.zeros(len(queries.terms), np.int64)
        sizes[known] = np.diff(ends)[at[known]]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(ends[:-1][at[known]] - self.ends[:-1][known], sizes[known]) + np.arange(self.ends[-1])
        self.docs = np.frombuffer(row["ordinals"], np.int32)[take].astype(np.int64)
        tf = np.frombuffer(row["tf"], np.int64)[take]
        norm = 10 + _scaled(lengths, n_docs, n_terms)
        self.impacts = np.repeat(queries.weights, sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[self.docs]))
        self.top = np.zeros(len(queries.terms), np.int64)
        if len(self.docs):
            self.top[known] = np.maximum.reduceat(self.impacts, self.ends[:-1][known])
        self.pairs: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[term], self.ends[term + 1])
        return self.docs[own], self.impacts[own]

    def intersect(self, a: int, b: int) -> tuple[int, np.ndarray]:
        """Joint maximum and documents of two terms; made once for all queries that use the pair."""
        if (a, b) not in self.pairs:
            (left, x), (right, y) = self.postings(a), self.postings(b)
            both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
            self.pairs[a, b] = (int((x[i] + y[j]).max()) if len(both) else 0, both)
        return self.pairs[a, b]


def _scaled(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(90 * length * n_docs) div n_terms, also where the product leaves 64 bits."""
    if len(lengths) and 90 * n_docs * int(lengths.max()) > LARGEST:
        return np.array([90 * n_docs * int(n) // n_terms for n in lengths], np.int64)
    return 90 * n_docs * lengths // max(n_terms, 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest positive scores, ties to smaller ids, best first."""
    stay = np.flatnonzero(scores > 0)
    if len(stay) > 4 * k:
        stay = stay[scores[stay] >= np.partition(scores[stay], -k)[-k]]
    order = stay[np.lexsort((ids[stay], -scores[stay]))[:k]]
    return scores[order], ids[order]


def pair_max_score(segment: Segment, members: np.ndarray, floor: int, k: int, work: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) that hold every one of the segment's k best documents with a score of at least `floor`."""
    none = np.zeros(0, np.int64)
    members = members[segment.top[members] > 0]
    if not len(members):
        return none, none
    left = members[0::2]
    right = np.append(members[1::2], -1)[: len(left)]  # an odd last term stands alone
    met = [segment.intersect(a, b) if b >= 0 else (0, none) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    single = np.maximum(segment.top[left], np.where(right >= 0, segment.top[right], 0))
    bound = np.maximum(single, [joint for joint, _ in met])
    order = np.argsort(bound, kind="stable")
    below = np.concatenate([[0], np.cumsum(bound[order])])  # what all weaker pairs can add
    floor = max(floor, 1)
    if below[-1] < floor:
        return none, none
    first = int(np.searchsorted(below[1:], floor, "left"))
    score = np.zeros(len(segment.ids), np.int64)
    opened = np.zeros(len(segment.ids), bool)
    for place in range(first, len(order)):
        unit = order[place]
        jointly = below[place] + single[unit] < floor
        if jointly:
            opened[met[unit][1]] = True
        for term in (left[unit], right[unit]):
            if term >= 0:
                docs, impacts = segment.postings(term)
                score[docs] += impacts
                if not jointly:
                    opened[docs] = True
    found = np.flatnonzero(opened)
    for place in range(first - 1, -1, -1):
        if len(found) > k:  # k documents already have these scores
            floor = max(floor, int(np.partition(score[found], -k)[-k]))
        found = found[score[found] + below[place + 1] >= floor]
        if not len(found):
            break
        for term in (left[order[place]], right[order[place]]):
            if term >= 0:
                docs, impacts = segment.postings(term)
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                score[found] += np.where(docs[at] == found, impacts[at], 0)
    if work is not None:
        work["scored"] = work.get("scored", 0) + len(found)
        work["all"] = work.get("all", 0) + len(np.unique(np.concatenate([segment.postings(t)[0] for t in members])))
    return best(score[found], segment.ids[found], k)


def terms_of(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term) of all distinct 64-bit term hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block, ALNUM, LOWER)
                owner = batch.column(0).take(pa.array(block.lo + w.row_of()))
                for at in range(0, len(w.hashes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([owner.slice(at, 1 << 16), pa.array(w.hashes[at : at + (1 << 16)].view(np.int64))], ["id", "term"])

    kept = rows.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    return kept.mapInArrow(run, "id bigint, term bigint").distinct()


def _packed(ids: list, lengths: list, hashes: list, rows: list) -> pa.RecordBatch:
    """One segment as a row of flat arrays."""
    n = np.concatenate(lengths)
    term, doc = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((doc, term))
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    vocabulary, counts = np.unique(term[first], return_counts=True)
    flat = [np.concatenate(ids), n, vocabulary, counts.astype(np.int64), doc[first].astype(np.int32), np.diff(np.append(first, len(term)))]
    names = [field.split()[0] for field in SEGMENTS.split(", ")]
    cells = [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in flat)]
    return pa.RecordBatch.from_arrays(cells, names)


def build_index(docs: DataFrame, log_terms: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of all documents for the terms (column `term`) of a query log.

    A Bloom filter of bounded size keeps other terms out; the few that pass cost space and change nothing. Documents
    without an id are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters.build(log_terms.select("term").distinct(), "term"))  # at most filters.MAX_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = n_docs = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                w = words(block, ALNUM, LOWER)
                hit = filters.passes(sent.value, w.hashes.view(np.int64))
                for part, values in zip(held, (ids[block.lo : block.hi], np.diff(w.bounds), w.hashes[hit], n_docs + w.row_of()[hit]), strict=True):
                    part.append(values)
                size, n_docs = size + len(block.data), n_docs + block.hi - block.lo
                if size >= SEGMENT_BYTES:
                    yield _packed(*held)
                    held, size, n_docs = ([], [], [], []), 0, 0
        if n_docs:
            yield _packed(*held)

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    index = materialize(rows.mapInArrow(run, SEGMENTS), "segments")
    sent.destroy()
    return index


def _document_frequencies(index: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vocabulary, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(vocabulary.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], ["term", "df"]
                )

    return index.select("vocabulary", "counts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _block(rows: pa.Table) -> Queries:
    """Queries of collected (id, term, weight) rows."""
    ids, term, weight = (rows[c].to_numpy() for c in ("id", "term", "weight"))
    terms, at, number = np.unique(term.view(np.uint64), return_index=True, return_inverse=True)
    order = np.lexsort((term, -weight, ids))
    known, first = np.unique(ids[order], return_index=True)
    return Queries(known.tolist(), terms, weight[at], np.split(number[order], first[1:]))


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased, compared by 64-bit hashes. Scores are
    the integers of the contract: weight by document frequency, saturated by length. Ties go to the smaller id.
    Null and empty texts have no terms and do not count as documents. Rows that repeat are documents of their own, so an id
    that stands on several rows can be returned several times; documents without an id take no part.
    Items that share an id are one item with all their terms; items without an id, without terms or without a
    matching document return nothing, and neither do empty tables.
    """
    spark = docs.sparkSession
    asked = materialize(terms_of(items, item_id, item_text), "asked")
    index = build_index(docs, asked, id, text)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = asked.join(_document_frequencies(index), "term").select("id", "term", weight.alias("weight"))
    n_blocks = max(1, -(-asked.count() // block_terms))
    weighed = materialize(weighed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "weighed")
    form = "item_id bigint, doc_id bigint, score bigint"
    parts = []
    for number in range(n_blocks):
        rows = weighed.filter(F.col("block") == number).toArrow()  # one block of the query set
        if not len(rows):
            continue
        sent = spark.sparkContext.broadcast(_block(rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.ids]
            for batch in batches:
                for row in range(len(batch)):
                    segment = Segment({c: batch.column(c)[row].as_py() for c in batch.schema.names}, queries, n_docs, n_terms)
                    for q, members in enumerate(queries.members):
                        scores, ids = tops[q]
                        got = pair_max_score(segment, members, int(scores[-1]) if len(scores) == k else 1, k)
                        if len(got[0]):
                            tops[q] = best(np.concatenate([scores, got[0]]), np.concatenate([ids, got[1]]), k)
            sizes = [len(scores) for scores, _ in tops]
            if sum(sizes):
                cells = [np.repeat(np.array(queries.ids, np.int64), sizes), np.concatenate([i for _, i in tops]), np.concatenate([s for s, _ in tops])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["item_id", "doc_id", "score"])

        found = index.drop("docs", "terms").mapInArrow(run, form)
        parts.append(materialize(found, f"block{number}"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return everything.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
