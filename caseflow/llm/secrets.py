"""Secret scans: base patterns plus a randomness test battery, in DataFrame functions only.

The battery takes long runs of key characters that no base match touches. For each run the encoding is inferred as the
smallest alphabet that holds all its characters, and three tests ask whether it looks like a uniform draw from it:
chi-squared uniformity, the number of runs above and below the middle of the alphabet, and the serial correlation
of neighbours. Their z-values add up to a chi-squared value of three degrees.

A run is reported if the battery does not reject randomness and if it is too even for ordinary words: the p-value
of its chi-squared statistic under ordinary letters or digits, whose mean and variance grow with the length.
Those p-values are held to a false-discovery rate by the Benjamini-Hochberg rule within each band of lengths,
over all candidates of the corpus, on counts per band and p-value bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.scale import materialize

# Fixed patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a maximal run, so the length can stand in the pattern
HEX = r"[0-9a-f]{24,}"  # likewise
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
# Encodings from the smallest alphabet to the largest.
ALPHABETS = (
    ("[0-9]+", "0123456789"),
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[A-Z2-7]+", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("[+/0-9A-Za-z]+", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z_-]+", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("[+/0-9A-Za-z_-]+", "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
# Letters of English prose in percent, a to z.
PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
RATE, LEVEL = 0.01, 0.001
BINS = 400


def ordinary_shares(alphabet: str) -> list[float]:
    """Shares of the characters that ordinary text would draw from an alphabet: letters as in prose, or digits by Benford's law."""
    lower = sorted(set(alphabet.lower()) & set("abcdefghijklmnopqrstuvwxyz"))
    weights = [PROSE[ord(c) - 97] for c in lower] or [math.log10(1 + 1 / d) for d in range(1, 10)]
    return [w / sum(weights) for w in weights]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Running sums of an array: each round adds what stands 1, 2, 4 ... places before, so rounds grow with the logarithm."""
    rounds = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.length(F.bin(F.size(values).cast("bigint"))))

    def add(acc: Column, r: Column) -> Column:
        shift = F.least(F.pow(F.lit(2.0), r).cast("int"), F.size(acc))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), shift), F.slice(acc, F.lit(1), F.size(acc) - shift)), lambda x, y: x + y)

    return F.aggregate(rounds, values, add)


def _below(ordered: Column, limit: Column, inclusive: bool) -> Column:
    """How many values of an ascending array are below `limit` (or equal to it), by halving."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(ordered).cast("bigint"))))

    def halve(x: Column, _step: Column) -> Column:
        middle = F.shiftright(x["lo"] + x["hi"], 1)
        value = F.get(ordered, middle)
        more = (value <= limit) if inclusive else (value < limit)
        done = x["lo"] >= x["hi"]
        return F.when(done, x).otherwise(
            F.struct(F.when(more, middle + 1).otherwise(x["lo"]).alias("lo"), F.when(more, x["hi"]).otherwise(middle).alias("hi"))
        )

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")), halve, lambda x: x["lo"])


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern with their code point positions: the pieces between them give the gaps."""
    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,value:string>>)")

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        ends = _running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        one = lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value")
        )
        return F.when(F.size(matches) > 0, F.zip_with(matches, ends, one)).otherwise(empty)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _untouched(runs: Column, base: Column) -> Column:
    """Runs that share no character with a base span.

    Base spans that end before a run also start before its end, so a run is touched when more of them start before
    its end than end by its start.
    """
    edges = F.struct(
        F.array_sort(F.transform(base, lambda b: b["start"])).alias("starts"), F.array_sort(F.transform(base, lambda b: b["end"])).alias("ends")
    )
    return _let(edges, lambda e: F.filter(runs, lambda r: _below(e["starts"], r["end"], False) == _below(e["ends"], r["start"], True)))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 1e-7)."""

    def upper(a: Column) -> Column:
        t = 1 / (1 + 0.2316419 * a)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) / 2.5066282746310002 * poly

    return _let(z, lambda v: F.when(v >= 0, 1 - upper(v)).otherwise(upper(-v)))


def _battery(value: Column) -> Column:
    """struct(n, ordinary, uniform): the run's length and its two p-values."""
    def encoding(alphabet: str) -> Column:
        shares = ordinary_shares(alphabet)
        sums = [F.lit(sum(q**power for q in shares)).alias(name) for power, name in ((2, "s2"), (3, "s3"))]
        return F.struct(F.lit(alphabet).alias("letters"), *sums)

    inferred = encoding(ALPHABETS[-1][1])
    for pattern, alphabet in reversed(ALPHABETS[:-1]):
        inferred = F.when(value.rlike(f"^{pattern}$"), encoding(alphabet)).otherwise(inferred)

    def stats(x: Column) -> Column:
        codes, k = x["codes"], x["k"].cast("double")
        n = F.size(codes).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, d: s + F.pow(F.size(F.filter(codes, lambda c: c == d)).cast("double"), F.lit(2.0)))
        mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
        high = F.size(F.filter(codes, lambda c: c * 2 >= k)).cast("double")
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k))).cast("double") + 1
        return _let(
            F.struct(k.alias("k"), n.alias("n"), squares.alias("sq"), mean.alias("mean"), high.alias("hi"), turns.alias("turns"), codes.alias("codes"), pairs.alias("pairs"), x["s2"].alias("s2"), x["s3"].alias("s3")), tests
        )

    def tests(s: Column) -> Column:
        k, n, high, low = s["k"], s["n"], s["hi"], s["n"] - s["hi"]
        chi = k / n * s["sq"] - n
        # Chi-squared as a normal value by its cube root (Wilson and Hilferty).
        df = k - 1
        z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        cross = 2 * high * low
        spread = cross * (cross - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (s["turns"] - cross / n - 1) / F.sqrt(spread)).otherwise(F.lit(9.0))
        around = F.aggregate(s["codes"], F.lit(0.0), lambda t, c: t + (c - s["mean"]) * (c - s["mean"]))
        along = F.aggregate(s["pairs"], F.lit(0.0), lambda t, p: t + (p["a"] - s["mean"]) * (p["b"] - s["mean"]))
        z_serial = F.when(around > 0, (along / around + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(9.0))
        total = F.greatest(z_chi, F.lit(0.0)) * F.greatest(z_chi, F.lit(0.0)) + z_runs * z_runs + z_serial * z_serial
        root = F.sqrt(total)
        uniform = 2 * (1 - normal_cdf(root)) + root * F.sqrt(F.lit(0.6366197723675814)) * F.exp(-total / 2)
        s2, s3 = s["s2"], s["s3"]
        mean = k * (1 + (n - 1) * s2) - n
        variance = 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2) * (k / n) * (k / n)
        ordinary = normal_cdf((chi - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9))))
        return F.struct(n.cast("int").alias("n"), ordinary.alias("ordinary"), uniform.alias("uniform"))

    def coded(e: Column) -> Column:
        codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.position(c, e["letters"]) - 1)
        return F.struct(codes.alias("codes"), F.length(e["letters"]).alias("k"), e["s2"].alias("s2"), e["s3"].alias("s3"))

    return _let(_let(inferred, coded), stats)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """One row per row: (id, n_assign, n_access, n_hex, base, spans).

    base and spans are sorted arrays of struct<start, kind, end> (code points, end exclusive; kind indexes KINDS);
    spans also holds the runs that the battery adds. A null text counts as empty. Repeated rows repeat, and
    each counts in the false-discovery control. Texts are read whole, whatever their length.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), body.alias("text"))
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6
    bare = lambda s: F.struct(s["start"], s["kind"], s["end"])
    found = rows.select(
        "id",
        F.transform(F.filter(_spans(F.col("text"), ASSIGN, 0), long_value), bare).alias("assign"),
        F.transform(_spans(F.col("text"), ACCESS, 1), bare).alias("access"),
        F.transform(_spans(F.col("text"), HEX, 2), bare).alias("hex"),
        _spans(F.col("text"), RUN, 3).alias("runs"),
    )
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    tested = F.transform(_untouched(F.col("runs"), F.col("base")), lambda r: F.struct(bare(r).alias("span"), _battery(r["value"]).alias("p")))
    found = materialize(
        found.select("id", *(F.size(c).cast("bigint").alias(f"n_{c}") for c in ("assign", "access", "hex")), "base", tested.alias("tested")), "found"
    )

    band = F.floor(F.log2(F.col("t.p.n").cast("double")) * 2).cast("int")
    place = F.least(F.floor(-F.log(F.greatest(F.col("t.p.ordinary"), F.lit(1e-80))) * 2).cast("int"), F.lit(BINS - 1))
    table = found.select(F.explode("tested").alias("t")).groupBy(band.alias("band"), F.greatest(place, F.lit(0)).alias("bin")).count().collect()
    counts: dict[int, dict[int, int]] = {}  # at most 64 bands of BINS bins
    for row in table:
        counts.setdefault(row["band"], {})[row["bin"]] = row["count"]
    cuts: dict[int, int] = {}
    for length_band, bins in counts.items():
        m, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            # All p-values of a bin are at most exp(-bin / 2).
            if 2.718281828459045 ** (-b / 2) <= rate * seen / m:
                cuts[length_band] = b

    def kept(t: Column) -> Column:
        n = t["p"]["n"].cast("double")
        limit = F.lit(BINS)
        for length_band, least in cuts.items():
            limit = F.when(F.floor(F.log2(n) * 2) == length_band, F.lit(least)).otherwise(limit)
        return (-F.log(F.greatest(t["p"]["ordinary"], F.lit(1e-80))) * 2 >= limit) & (t["p"]["uniform"] >= level)

    added = F.transform(F.filter("tested", kept), lambda t: t["span"])
    return found.select("id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: str | Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
