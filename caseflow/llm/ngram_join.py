"""N-gram Jaccard join over parity sketches.

A document's shingles are XOR-hashed into sketches. In the narrow one every shingle flips one bit, so the Hamming
distance of two sketches never exceeds the symmetric difference of the two sets. In the wide one every shingle
flips hashed bits of one segment, so no more segments differ than shingles do. At a Jaccard similarity of p percent
that difference is at most (|A| + |B|)(100 - p) / (100 + p). Sizes fall into bands; in the band of the larger
set the wide sketch has more segments than can differ, so two linked sets agree in whole segments
(pigeonhole), which are the join keys. A document takes part in its own band and, where a larger partner may
be in the next one, there too.

1. Equal sets collapse into one class, represented by its smallest id.
2. Members of a key are compared with the key's smallest id; what passes the sketch distance is verified on
   the whole shingle sets, one partner per document first, then the pairs that are not connected by that.
3. Keys whose members are not all connected yet are settled with twice the segments: linked sets then share
   many keys, and by the prefix principle at least one among the rarest of each side, so that groups of
   thousands of near copies meet only at the keys that tell them apart. Pairs already connected are skipped.

No key is dropped and no number of partners is capped, so every pair over the threshold ends in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseflow.llm import filters
from caseflow.llm.components import components
from caseflow.llm.scratch import discard
from caseflow.llm.textblocks import LOWER, NOT_SPACE, Words, blocks, mix, release, rolling, words
from caseflow.scale import materialize

SKETCH_WORDS = 16  # 1,024 bits at least; twice as many bits as shingles
# Keys that one task counts at a time.
PART_KEYS = 1 << 19
# Pairs of one document that one task verifies.
PAIR_ROWS = 512
# Text bytes, and keys, that a task works on at once.
BLOCK_BYTES, KEYS_AT_ONCE = 1 << 18, 1 << 17
_OTHER = np.uint64(0xA0761D6478BD642F)


class Bands:
    """Size bands for a similarity of `percent`: band k holds the sizes over upper[k-1] up to upper[k]."""

    def __init__(self, percent: int, ratio: float = 0.7, largest: int = 1 << 40):
        self.percent, self.upper = percent, [1]
        while self.upper[-1] < largest:
            self.upper.append(max(self.upper[-1] + 1, int(self.upper[-1] / ratio)))
        self._upper = np.asarray(self.upper)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._upper, sizes)

    def last(self, sizes: np.ndarray) -> np.ndarray:
        """Band of the largest possible partner."""
        return self.of(sizes * 100 // self.percent)

    def distance(self, band: int) -> int:
        """Most shingles in which two linked sets differ, the larger one being in this band."""
        return 2 * self.upper[band] * (100 - self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        """Segments beyond the pigeonhole's need, so that a document may leave out so many empty ones."""
        need = self.distance(band) + 1
        empty = need * math.exp(-(self.upper[max(band - 1, 0)]) / need)
        return math.ceil(empty + 4 * math.sqrt(empty))

    def extra(self, band: int) -> int:
        """Filled segments, beyond the first, in which two linked sets agree for certain.

        The fewer shingles a segment holds, the more segments agree by chance, and the more are asked for.
        """
        held = (100 + self.percent) // (2 * (100 - self.percent))
        return 1 + (self.distance(band) + 1) // max(held, 1)

    def segments(self, band: int, fine: bool) -> int:
        need = self.distance(band) + 1
        return 2 * need if fine else need + self.spare(band) + self.extra(band)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (row, hash), by row: `size` words each, or all words of a row that has fewer."""
    counts = np.diff(w.bounds)
    row_end = w.row_end()
    full = np.flatnonzero(np.arange(max(len(w.hashes) - size + 1, 0)) + size <= row_end[: max(len(w.hashes) - size + 1, 0)])
    rows, hashes = [w.row_of()[full]], [rolling(w.hashes, size)[full]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            hashes.append(mix(rolling(w.hashes, n)[w.bounds[:-1][short]] + np.uint64(n)))
    row, value = np.concatenate(rows), mix(np.concatenate(hashes))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def parity(row: np.ndarray, value: np.ndarray, n_rows: int, width: int = SKETCH_WORDS) -> np.ndarray:
    """Bit sketch of every row: each shingle flips one of width * 64 bits (a power of two).

    The XOR of the halves of a sketch is the sketch of half the width.
    """
    bits = width * 64
    at = row * bits + (value & np.uint64(bits - 1)).astype(np.int64)
    flips = (np.bincount(at, minlength=n_rows * bits) & 1).astype(np.uint8)
    return np.packbits(flips, bitorder="little").view(np.uint64).reshape(n_rows, width)


def sketches(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sketches as wide as each row's set asks for."""
    width = np.full(len(sizes), SKETCH_WORDS)
    while (narrow := width * 32 < sizes).any():
        width[narrow] *= 2
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sizes)
    base = np.concatenate([[0], np.cumsum(sizes)])
    for w in np.unique(width):
        for r in np.flatnonzero(width == w):
            own = value[base[r] : base[r + 1]]
            found[r] = parity(np.zeros(len(own), np.int64), own, 1, int(w))[0]
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(flat.view(np.int64)))


def segment_parity(row: np.ndarray, value: np.ndarray, n_rows: int, segments: int) -> np.ndarray:
    """Wide sketch of every row: each shingle flips 64 hashed bits of the segment that its value picks.

    Values rise within a row, and so do their segments. Segments without shingles are 0.
    """
    place = row * segments + ((value >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    sketch = np.zeros(n_rows * segments, np.uint64)
    if len(place):
        first = np.flatnonzero(np.diff(place, prepend=-1))
        sketch[place[first]] = np.bitwise_xor.reduceat(mix(value + _OTHER), first)
    return sketch.reshape(n_rows, segments)


def set_hashes(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every row's whole set, 0 for empty ones."""
    one, two = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    if len(value):
        first = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]])
        one[sizes > 0] = np.add.reduceat(mix(value ^ _OTHER), first)
        two[sizes > 0] = np.add.reduceat(mix(value + np.uint64(1)), first)
    return one, two


def band_keys(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, bands: Bands, fine: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(band, rows, keys by row, keys a row has to emit) for all bands that rows of these sets take part in.

    In the coarse form empty segments are 0 where a row may leave them out.
    """
    own, last = bands.of(sizes), bands.last(sizes)
    base = np.concatenate([[0], np.cumsum(sizes)])
    for band in np.unique(np.concatenate([own, last])):
        need = bands.distance(band) + 1
        rows = np.flatnonzero((sizes > 0) & (own <= band) & (band <= last))
        if need < 2 or not len(rows):
            continue  # without room for a difference only equal sets link, and those have collapsed
        segments = bands.segments(band, fine)
        step = max(1, KEYS_AT_ONCE // segments)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            take = np.concatenate([np.arange(base[r], base[r + 1]) for r in part])
            sketch = segment_parity(np.repeat(np.arange(len(part)), sizes[part]), value[take], len(part), segments)
            tag = mix(np.arange(segments, dtype=np.uint64) + (np.uint64(int(band)) << np.uint64(40)) + (np.uint64(fine) << np.uint64(60)))
            keys = mix(sketch ^ tag) | np.uint64(1)
            if not fine:
                empty = sketch == 0
                keys[empty & (empty.sum(1) <= bands.spare(band))[:, None]] = 0
            yield int(band), part, keys, need


def _signatures(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK_BYTES):
                n_rows = len(block.bounds) - 1
                row, value = shingle_sets(words(block, NOT_SPACE, LOWER), size)
                sizes = np.bincount(row, minlength=n_rows)
                one, two = set_hashes(value, sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.lo, n_rows),
                        pa.array(sizes, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([bands.extra(b) for b in bands.of(sizes)], pa.int32()),
                        pa.array([sum(bands.segments(b, False) for b in range(lo, hi + 1)) for lo, hi in zip(bands.of(sizes), bands.last(sizes), strict=True)], pa.int64()),
                        sketches(row, value, sizes),
                    ],
                    ["id", "n", "one", "two", "extra", "n_keys", "sketch"],
                )
        release()

    return docs.mapInArrow(run, "id bigint, n bigint, one bigint, two bigint, extra int, n_keys bigint, sketch array<bigint>")


def _scan(docs: DataFrame, size: int, emit, schema: str, held: filters.Held, ids: DataFrame | None = None) -> DataFrame:
    """emit(ids, rows, hashes, sizes) per block of shingle sets; with `ids` only of those documents, and few others."""
    sent = None
    if ids is not None:
        ids = materialize(ids.select(F.xxhash64("id").alias("h")).distinct(), "ids")
        sent = held.filter(ids, "h")
        discard(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                batch = batch.filter(pa.array(filters.passes(sent.value, batch.column(2).to_numpy())))
            for block in blocks(batch.column(1), BLOCK_BYTES):
                n_rows = len(block.bounds) - 1
                row, value = shingle_sets(words(block, NOT_SPACE, LOWER), size)
                yield from emit(batch.column(0).slice(block.lo, n_rows), row, value, np.bincount(row, minlength=n_rows))
        release()

    return docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(run, schema)


def _key_hash(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of a key, and 32 of its bits: enough to tell which keys may be shared."""
    return (keys % np.uint64(parts)).astype(np.int64), keys >> np.uint64(32)


def _counted_keys(docs: DataFrame, size: int, bands: Bands, fine: bool, total: int, ids: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(h, k): hashes of keys that at least two different sets emit, and by how many; the number of parts.

    Keys travel packed in eight bytes, 32 bits of the key and 32 of a hash of key and whole set, which is equal for
    copies and differs from key to key. Linked sets share at least two keys, so that a link is lost only where 32 bits
    collide at each of them; keys that collide are looked at in vain. A part holds about PART_KEYS keys, whatever
    the input, and a key counts at most once per document in it.
    """
    parts = int(total // PART_KEYS) + 1

    def emit(own: pa.Array, row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = set_hashes(value, sizes)[0]
        found = [np.zeros(0, np.uint64)]
        where = [np.zeros(0, np.int64)]
        for _, rows, keys, _ in band_keys(row, value, sizes, bands, fine):
            at, keys = np.repeat(rows, keys.shape[1]), keys.ravel()
            part, short = _key_hash(keys[keys != 0], parts)
            found.append((short << np.uint64(32)) | (mix(whole[at[keys != 0]] ^ keys[keys != 0]) >> np.uint64(32)))
            where.append(part)
        packed, part = np.concatenate(found), np.concatenate(where)
        order = np.lexsort((packed, part))
        packed, part = packed[order], part[order]
        new = np.ones(len(packed), bool)
        new[1:] = (packed[1:] != packed[:-1]) | (part[1:] != part[:-1])
        packed, part = packed[new], part[new]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        pieces = [x.tobytes() for x in np.split(packed, cuts[1:])] if len(packed) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(pieces, pa.binary())], ["part", "keys"])

    def count(group: pa.Table) -> pa.Table:
        part = np.uint64(group["part"][0].as_py())
        packed = np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64)
        packed = np.unique(packed)
        short, k = np.unique(packed >> np.uint64(32), return_counts=True)
        h = mix((part << np.uint64(40)) ^ short[k > 1])
        return pa.table({"h": pa.array(h.view(np.int64)), "k": pa.array(k[k > 1], pa.int64())})

    with filters.Held(docs) as held:
        packed = _scan(docs, size, emit, "part int, keys binary", held, ids)
        return materialize(packed.groupBy("part").applyInArrow(count, "h bigint, k bigint"), "counted"), parts


def _keys(docs: DataFrame, size: int, bands: Bands, fine: bool, counted: tuple[DataFrame, int], held: filters.Held, ids: DataFrame | None = None) -> DataFrame:
    """(key, h, id, band, need) for counted keys, and few others. Of copies in one block only the smallest id emits."""
    shared, parts = counted
    sent = held.filter(shared, "h")

    def emit(own: pa.Array, row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers = own.to_numpy()
        whole = set_hashes(value, sizes)[0]
        order = np.lexsort((numbers, whole))
        copy = np.zeros(len(numbers), bool)
        copy[order[1:]] = whole[order[1:]] == whole[order[:-1]]
        for band, rows, found, need in band_keys(row, value, sizes, bands, fine):
            found[copy[rows]] = 0
            keys, at = found.ravel(), np.repeat(rows, found.shape[1])
            part, short = _key_hash(keys, parts)
            h = mix((part.astype(np.uint64) << np.uint64(40)) ^ short)
            ok = (keys != 0) & filters.passes(sent.value, h)
            rest = [pa.array(np.full(int(ok.sum()), x), pa.int32()) for x in (band, need)]
            out = [pa.array(keys[ok].view(np.int64)), pa.array(h[ok].view(np.int64)), pa.array(numbers[at[ok]])]
            yield pa.RecordBatch.from_arrays([*out, *rest], ["key", "h", "id", "band", "need"])

    return _scan(docs, size, emit, "key bigint, h bigint, id bigint, band int, need int", held, ids)


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items): whole shingle sets of the documents in `ids`, and of few others."""

    def emit(own: pa.Array, row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(value.view(np.int64)))
        yield pa.RecordBatch.from_arrays([own, items], ["id", "items"])

    with filters.Held(docs) as held:
        return materialize(_scan(docs, size, emit, "id bigint, items array<bigint>", held, ids), "sets")


def _bound(percent: int):
    return F.expr(f"(na + nb) * {100 - percent} div {100 + percent}")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Keep (a, b) with na, nb, sa, sb by what sizes and sketches allow; sizes so close differ by one width at most."""
    sized = pairs.filter(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    width = F.least(F.size("sa"), F.size("sb"))

    def folded(sketch: str) -> Column:
        halves = F.zip_with(F.slice(sketch, F.lit(1), width), F.slice(sketch, width + 1, width), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) > width, halves).otherwise(F.col(sketch))

    apart = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return sized.filter(apart <= _bound(percent))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough, written to the shared folder.

    A document with many partners is dealt over tasks of PAIR_ROWS pairs, and its set is repeated in each of them. More
    than a ten-thousandth of all pairs go to one task where fewer would make that list of documents unbounded.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    load = F.greatest(F.lit(float(PAIR_ROWS)), pairs.agg(F.count(F.lit(1)) / 10_000).scalar())
    busy = pairs.groupBy("a").count().filter(F.col("count") > load)
    busy = F.broadcast(busy.select("a", F.ceil(F.col("count") / load).cast("int").alias("parts")))  # fewer than 10,000 rows
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), size)
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    dealt = pairs.join(busy, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    repeated = left.join(busy, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = dealt.join(right, "b").join(repeated, ["a", "part"])
    shared = F.size(F.array_intersect("x", "y"))
    kept = both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared))
    verified = materialize(kept.select("a", "b").distinct(), "verified")
    discard(sets, pairs)
    return verified


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int, before: DataFrame | None = None) -> DataFrame:
    """Links among candidate pairs, enough for their components: `before` and these connect what all links connect.

    Every document is compared with its smallest partner first; of the other pairs only those that are not
    connected by then are left to compare.
    """
    first = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")), "first")
    links = _verified(first, docs, size, percent)
    links = links if before is None else links.unionByName(before)
    known = components(links)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    return materialize(links.unionByName(_verified(rest, docs, size, percent)), "links")


def ngram_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id).

    Texts are lower-cased (A-Z) and split at white space; a set holds the distinct shingles of `size` words,
    or the whole sequence of a shorter text. Two texts link when 100 * |A & B| >= percent * |A | B|.
    component_id is the smallest id reachable by links. Null and empty texts have no shingles, link with
    nothing and keep their own id. Repeated rows repeat in the result. A row with a null id takes the
    component of its equal texts, and null if there are none.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = materialize(_signatures(source, size, bands), "signatures")
    classes = materialize(signed.filter("n > 0").groupBy("one", "two", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    narrow = materialize(signed.join(reps, "id", "left_semi").select("id", "n", "extra", "sketch").dropDuplicates(["id", "n"]), "narrow")
    single = source.filter("id IS NOT NULL")
    total = signed.agg(F.sum("n_keys")).first()[0] or 0
    counted = _counted_keys(single, size, bands, False, total)
    with filters.Held(docs) as held:
        found = _keys(single, size, bands, False, counted, held).select("key", "id").distinct()
        found = materialize(found.join(reps, "id", "left_semi"), "found")
    pivots = found.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top").drop("top")
    pivots = materialize(pivots, "pivots")
    members = materialize(found.join(pivots, "key"), "members")
    discard(counted[0], found, pivots)

    def side(which: str) -> DataFrame:
        return narrow.select(F.col("id").alias(which), F.col("n").alias(f"n{which}"), F.col("sketch").alias(f"s{which}"))

    stars = members.filter("id <> pivot").select(F.col("id").alias("b"), F.col("pivot").alias("a")).distinct()
    stars = materialize(_near(stars.join(side("b"), "b").join(side("a"), "a"), percent).select("a", "b").distinct(), "stars")
    links = _linked(stars, single, size, percent)
    discard(stars)

    # Members of keys that are not connected yet; a key of two documents is settled by its one comparison.
    known = materialize(components(links), "known")
    placed = members.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("part").alias("p"), F.max("part").alias("q")).filter("k > 2 AND p < q")
    # Two linked documents that are not connected yet share more than `extra` keys, all of them open but for one
    # whose owners collide in _counted_keys.
    unsettled = placed.join(open_keys.select("key"), "key", "left_semi").groupBy("id", "part").agg(F.countDistinct("key").alias("keys"))
    unsettled = unsettled.join(narrow.groupBy("id").agg(F.min("extra").alias("extra")), "id").filter("keys >= extra").select("id", "part")
    unsettled = materialize(unsettled, "unsettled")
    discard(members, known)

    # Of its 2 * need keys a document takes part with the `need` rarest; those it shares with nobody come first.
    total = 2 * (signed.join(unsettled, "id", "left_semi").agg(F.sum("n_keys")).first()[0] or 0)
    counted = _counted_keys(single, size, bands, True, total, unsettled)
    rank = F.row_number().over(Window.partitionBy("id", "band").orderBy(F.desc("k"), F.desc("key")))
    with filters.Held(docs) as held:
        shared = _keys(single, size, bands, True, counted, held, unsettled).distinct().join(counted[0], "h").withColumn("rank", rank)
        rare = shared.filter("rank > need").select("key", "id")  # `need` of 2 * need keys, the most frequent, stay out
        rare = materialize(rare.join(unsettled, "id").join(narrow, "id"), "rare")
    left = rare.select("key", F.col("id").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = rare.select("key", F.col("id").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    more = materialize(_near(left.join(right, "key").filter("a < b AND pa <> pb"), percent).select("a", "b").distinct(), "more")
    discard(rare, counted[0])
    links = _linked(more, single, size, percent, links)
    discard(more, unsettled)

    final = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("one", "two", "n", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "one", "two").join(final, ["one", "two", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group of near copies: the one with the smallest id; all columns of `docs` stay.

    Rows of one id and one text count as copies, and one of them stays; different texts under one id are documents of
    their own. Rows without an id, and texts without words, stay.
    """
    number, mark = F.col(id).cast("bigint"), F.xxhash64(F.col(text).cast("string"))
    seen = docs.groupBy(number.alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min(mark).alias("_first"), F.max(mark).alias("_last"))
    repeated = materialize(seen.filter("_id IS NOT NULL AND _n > 1"), "repeated")
    torn = repeated.filter("_first <> _last").select("_id", "_first")
    split = not torn.isEmpty()
    keyed = docs.withColumn("__node", number)
    if split:
        # The text with the smallest hash keeps the id, every other one goes by a hash of both.
        node = F.when(mark == F.col("_first"), number).otherwise(F.xxhash64(number, mark))
        several = materialize(docs.join(torn, number == F.col("_id")).withColumn("__node", node), "several")
        keyed = filters.without(docs, torn.select("_id"), id).withColumn("__node", number).unionByName(several.drop("_id", "_first"))
        repeated = materialize(keyed.groupBy(F.col("__node").alias("_id")).count().filter("_id IS NOT NULL AND count > 1"), "repeated_nodes")
    repeated = repeated.select("_id")

    found = ngram_components(keyed, "__node", text, size, percent)
    stays = F.col("component_id")
    if split:
        found = materialize(found, "found")
        real = several.select(F.col("__node").alias("id"), F.col("_id").alias("real")).distinct()
        mixed = found.join(found.join(real, "id", "left_semi").select("component_id").distinct(), "component_id", "left_semi")
        smallest = mixed.join(real, "id", "left").groupBy("component_id").agg(F.min(F.struct(F.coalesce("real", "id"), "id"))["id"].alias("smallest"))
        found = found.join(smallest, "component_id", "left")
        stays = F.coalesce("smallest", "component_id")
    losers = materialize(found.filter(F.col("id") != stays).select(F.col("id").alias("_id")), "losers")
    kept = filters.without(keyed, losers.union(repeated), "__node")
    again = keyed.join(repeated.join(losers, "_id", "left_anti"), F.col("__node") == F.col("_id"), "left_semi")
    return kept.unionByName(again.dropDuplicates(["__node"])).drop("__node")
