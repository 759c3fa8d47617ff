"""Ranked-answer parsing and truth ranks, one row at a time and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import after_think, let, strip
from caseflow.functions.variants import get, is_object, is_string

STRICT = {"allowSingleQuotes": "false"}
LENIENT = {"allowSingleQuotes": "false", "allowBackslashEscapingAnyCharacter": "true"}


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "“”‘’", "\"\"''")


def ranking_of(values: Column, candidates: Column) -> Column:
    """Candidate names in an array of VARIANT: texts, or objects' `category`; first occurrence kept."""
    names = F.transform(
        values,
        lambda v: F.when(is_string(v), strip(get(v, "$", "string"))).when(
            is_object(v), strip(F.coalesce(get(v, "$.category", "string"), F.lit("")))
        ),
    )
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & F.array_contains(candidates, n)))


def json_rankings(text: Column, candidates: Column) -> Column:
    """Rankings of the JSON arrays that begin at any `[` of the text, in order of position.

    The piece up to the next `[` is tried first; only an array that goes on beyond it (nested arrays,
    brackets inside strings) is decoded from the rest of the text, up to the last piece that holds a `]`. Behind
    that piece no array can end, so brackets that are never closed cost no more than their own piece.
    """
    def bounded(pieces: Column) -> Column:
        last = F.array_max(F.transform(pieces, lambda p, i: F.when(p.contains("]"), i)))
        return F.struct(pieces.alias("pieces"), F.coalesce(last, F.lit(-1)).alias("last"))

    return let(let(F.split(text, r"\[", -1), bounded), lambda b: _json_rankings(b["pieces"], b["last"], candidates))


def _json_rankings(pieces: Column, last: Column, candidates: Column) -> Column:
    starts = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    # A JSON value, a closing bracket, or the next `[` has to follow; all else cannot be JSON.
    plausible = F.filter(starts, lambda k: F.get(pieces, k).rlike(r'^\s*(["{\-0-9tfnNI\]]|$)'))

    def decode(k: Column) -> Column:
        flat = F.concat(F.lit("["), F.get(pieces, k))
        rest = F.when(k < last, F.concat(F.lit("["), F.array_join(F.slice(pieces, k + 1, last - k + 1), "[")))
        return F.coalesce(F.from_json(flat, "array<variant>", STRICT), F.from_json(rest, "array<variant>", STRICT))

    return F.transform(plausible, lambda k: ranking_of(decode(k), candidates))


def literal_as_json(block: Column) -> Column:
    """JSON text of a flat bracket block written as a Python literal; broken text for anything else.

    The block is cut into strings, words and punctuation, so nothing inside a string is touched. Strings get
    double quotes, neighbouring strings join, trailing commas go, None / True / False / ... become null and
    other words make the text invalid, as they do for a literal.
    """
    string = r""" "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' """.replace(" ", "")
    found = F.regexp_extract_all(block, F.lit(rf"""({string}|[\[\](){{}},:]|[^"'\s\[\](){{}},:]++|["'])"""), F.lit(1))
    return let(found, _joined_tokens)


def _joined_tokens(tokens: Column) -> Column:
    def is_string(i: Column) -> Column:
        token = F.get(tokens, i)  # a lone quote mark is a token of length 1
        return F.coalesce((F.length(token) > 1) & F.left(token, F.lit(1)).isin("'", '"'), F.lit(False))

    def rewrite(token: Column, i: Column) -> Column:
        body = F.substring(token, F.lit(2), F.length(token) - 2)
        body = F.when(F.left(token, F.lit(1)) == "'", F.regexp_replace(body, r'(?<!\\)"', r'\\"')).otherwise(body)
        text = F.concat(
            F.when(is_string(i - 1), "").otherwise('"'), body, F.when(is_string(i + 1), "").otherwise('"')
        )
        closes = F.coalesce(F.get(tokens, i + 1).isin("]", "}", ")"), F.lit(False))
        return (
            F.when(is_string(i), text)
            .when(token == ",", F.when(closes, "").otherwise(","))
            .when(token.isin("(", "["), "[")
            .when(token.isin(")", "]"), "]")
            .when(token.isin("{", "}", ":"), token)
            .when(token.isin("None", "True", "False", "..."), "null")
            .when(token.rlike(r"^[-+]?\d+(\.\d+)?([eE][-+]?\d+)?$"), token)
            .otherwise("!")
        )

    return F.array_join(F.transform(tokens, rewrite), "")


def literal_rankings(text: Column, candidates: Column) -> Column:
    """Rankings of the flat bracket blocks that are Python literals, in order of position."""
    blocks = F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]*\])"), F.lit(1))
    # Without a quote there is no name in the block.
    named = F.filter(blocks, lambda b: b.rlike("[\"']"))
    return F.transform(
        named, lambda b: ranking_of(F.from_json(literal_as_json(b), "array<variant>", LENIENT), candidates)
    )


def all_rankings(text: Column, candidates: Column) -> Column:
    """Distinct non-empty rankings in order of discovery: JSON arrays first, then literal blocks."""
    normal = straight_quotes(text)
    found = F.concat(json_rankings(normal, candidates), literal_rankings(normal, candidates))
    return F.array_distinct(F.filter(found, lambda r: F.size(r) > 0))


def best_ranking(rankings: Column) -> Column:
    """The longest ranking, the last found among equals; null when there is none."""
    scored = F.transform(
        rankings, lambda r, i: F.struct(F.size(r).alias("n"), i.alias("i"), r.alias("ranking"))
    )
    return F.array_max(scored)["ranking"]


def mention_ranking(text: Column, candidates: Column) -> Column:
    """Candidates by first mention in the closing part of the final answer; null when none is named."""
    closing = F.right(after_think(text), F.lit(vocab.FALLBACK_TAIL))

    def place(tail: Column) -> Column:
        return F.transform(
            candidates, lambda c: F.struct(F.call_function("position", c, tail).alias("at"), c.alias("name"))
        )

    named = F.transform(F.array_sort(F.filter(let(closing, place), lambda p: p["at"] > 0)), lambda p: p["name"])
    return let(named, lambda names: F.when(F.size(names) > 0, names))


def truth_rank(ranking: Column, truth: Column) -> Column:
    """1-based rank of the truth; null when it is missing from the ranking."""
    return F.nullif(F.array_position(ranking, truth), F.lit(0)).cast("int")
