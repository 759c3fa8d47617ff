"""String expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import vocab

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, although it is used inside inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_distinct(values: Column) -> Column:
    """Stripped, non-empty, first occurrence of each, in order (array of string)."""
    return F.array_distinct(
        F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x != "")
    )


def truncate_middle(text: Column, max_chars: int, marker: str) -> Column:
    """Keep head and tail halves of a text longer than `max_chars`, with `marker` between."""
    half = max_chars // 2
    kept = F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))
    return F.when(F.length(text) > max_chars, kept).otherwise(text)


def after_think(text: Column) -> Column:
    """The part after the last end-of-thinking tag; the whole text if there is none."""
    return F.substring_index(text, vocab.THINK_END, -1)


def before_think(text: Column) -> Column:
    return F.substring_index(text, vocab.THINK_END, 1)


def embedded_json(text: Column) -> Column:
    """JSON text of an answer: the last fenced json block, else from the first `{` to the last `}`."""
    fenced = F.try_element_at(
        F.regexp_extract_all(text, F.lit(r"(?is)```json\s*(.*?)\s*```"), F.lit(1)), F.lit(-1)
    )
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when(
        (start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substring(text, start, end - start + 1)
    )
    return F.coalesce(fenced, braces)


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill `{name}` places of a template; `{{` and `}}` stand for braces.

    The template is cut once while the plan is built, so a value that itself contains `{name}` is never
    filled again, and the row expression is one `concat`.
    """
    parts: list[Column] = []
    for literal, name, _spec, _conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")
