"""URL rules decided by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix; it fits the host, its subdomains, and every path that starts with the prefix.
For a URL and a rule shape (labels of the host, characters of the path) there is one key that could be listed, so the
keys that the corpus can ever ask for are known: they are the key universe. Level 1 of a cascade holds the listed
keys, level 2 the keys of the universe that pass level 1 without being listed, level 3 the listed keys that pass
level 2, and so on until a level has no false positives left. The first level that a key fails decides it, so that
membership is exact for every key of the universe and pages are judged in their scan, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.scale import materialize

# A level is one array of at most this many 64-bit words (32 MB), which every executor holds.
MAX_WORDS = 1 << 22
# Bits per listed key that the largest level still has; longer lists raise instead of losing exactness or memory.
MIN_BITS_PER_KEY = 2
# One test per shape stands in the plan.
MAX_SHAPES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table of one row with the words, the number of bits, and hash pairs per key."""

    words: DataFrame
    bits: int
    pairs: int
    seed: int
    members: int


@dataclass(frozen=True)
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for depth, level in reversed(list(enumerate(self.levels, 1))):
            verdict = F.when(_passes(level, key), verdict).otherwise(F.lit(depth % 2 == 0))
        return verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _places(key: Column, bits: int, pairs: int, seed: int) -> list[Column]:
    """Bit positions of a key, two per 64-bit hash."""
    hashes = [F.xxhash64(key, F.lit(seed), F.lit(i)) for i in range(pairs)]
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(bits - 1).cast("bigint")) for h in hashes for s in (0, 32)]


def _passes(level: Level, key: Column) -> Column:
    words = level.words.scalar()
    tests = [
        F.call_function("getbit", F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
        for p in _places(key, level.bits, level.pairs, level.seed)
    ]
    return reduce(lambda a, b: a & b, tests)


def _level(members: DataFrame, n: int, others: int, seed: int) -> Level:
    """Filter of the `n` keys in `members`; fewer false positives the more `others` will be asked."""
    hashes = max(2, min(12, round(max(others / n, 1)).bit_length()))
    pairs = (hashes + 1) // 2
    wanted = int(1.45 * 2 * pairs * n) + 64
    bits = min(1 << (wanted - 1).bit_length(), MAX_WORDS * 64)
    if n * MIN_BITS_PER_KEY > bits:
        raise ValueError(f"{n} keys are more than one cascade holds in {MAX_WORDS * 8 >> 20} MB; split the list")
    set_bits = members.select(F.explode(F.array(*_places(F.col("key"), bits, pairs, seed))).alias("_p")).select(
        F.shiftright("_p", 6).alias("at"), F.expr("shiftleft(1L, CAST(_p & 63L AS INT))").alias("word")
    )
    zeros = members.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("word"))
    words = set_bits.unionByName(zeros).groupBy("at").agg(F.bit_or("word").alias("word"))
    row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]).alias("words"))  # MAX_WORDS
    return Level(materialize(row, "level"), bits, pairs, seed, n)


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int) -> Cascade:
    """Cascade over the column `key` of `listed`, exact for every key in `universe` (which may repeat keys).

    `universe_size` is an estimate that only sets the size of the first level. Null keys are not listed. An empty
    list gives a cascade without levels, which holds nothing.
    """
    own = materialize(listed.select("key").filter("key IS NOT NULL").distinct(), "listed")
    n_own, n_others = own.count(), universe_size
    others: DataFrame | None = None
    levels: list[Level] = []
    while n_own:
        level = _level(own, n_own, n_others, len(levels))
        levels.append(level)
        if others is None:
            # The one pass over the universe. Keys that pass meet the listed ones in an aggregate, not in a join.
            asked = universe.filter("key IS NOT NULL").filter(_passes(level, F.col("key"))).select("key", F.lit(False).alias("_own"))
            met = asked.distinct().unionByName(own.select("key", F.lit(True).alias("_own")))
            others = met.groupBy("key").agg(F.bool_or("_own").alias("_own")).filter("NOT _own").select("key")
        else:
            others = others.filter(_passes(level, F.col("key")))
        others = materialize(others, "passing")
        own, others, n_own, n_others = others, own, others.count(), n_own
    return Cascade(levels)


def _key(host: Column, path: Column, labels: int, length: int) -> Column:
    """The key that a URL has for a shape, null where its host or path is too short."""
    dots = F.length(host) - F.length(F.translate(host, ".", ""))
    key = F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length))
    return F.when((dots >= labels - 1) & (F.length(path) >= length), key)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with _host, _path, _rule and _verdict (replaced where columns of these names exist).

    `rules` has host, path and verdict (allow or block). Of all rules that fit, the longest host and path together
    wins, of equally long ones the longer host; a rule listed with both verdicts blocks. A URL that no rule fits is in
    neither list: its rule is null and its verdict `default`. Null and empty URLs, and those without `://`, have an
    empty host and path and are judged like others. Every row is judged on its own, so repeated rows and ids stay.
    Rules with a null part are ignored; no pages give no rows, no rules give the default everywhere.
    """
    parts = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    keyed = materialize(
        parts.select(
            F.concat("host", "path").alias("key"),
            (F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels"),
            F.length("path").alias("length"),
            "verdict",
        ),
        "rules",
    )
    shapes = [(r["labels"], r["length"]) for r in keyed.select("labels", "length").distinct().orderBy("labels", "length").limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules have more than {MAX_SHAPES} combinations of host labels and path lengths; split the list")
    host, path = host_and_path(F.col(url))
    judged = pages.withColumns({"_host": host, "_path": path})
    if not shapes:
        return judged.withColumns({"_rule": F.lit(None).cast("string"), "_verdict": F.lit(default)})

    keys = [_key(F.col("_host"), F.col("_path"), labels, length) for labels, length in shapes]
    universe = pages.select(host.alias("_host"), path.alias("_path")).select(F.explode(F.array(*keys)).alias("key"))
    asked = pages.count() * len(shapes)
    # The first cascade tells listed keys from all others, the second, over the listed keys alone, blocked from allowed ones.
    listed = build_cascade(keyed, universe, asked)
    blocked = build_cascade(keyed.filter("verdict = 'block'"), keyed, keyed.count())
    fits = [
        F.when(
            listed.holds(key),
            F.struct(F.length(key).alias("long"), F.length(F.substring_index("_host", ".", -labels)).alias("host"), key.alias("key")),
        )
        for key, (labels, _) in zip(keys, shapes, strict=True)
    ]
    best = fits[0] if len(fits) == 1 else F.greatest(*fits)
    judged = judged.withColumn("_rule", best["key"])
    verdict = F.when(F.col("_rule").isNull(), default).when(blocked.holds(F.col("_rule")), "block").otherwise("allow")
    return judged.withColumn("_verdict", verdict)
