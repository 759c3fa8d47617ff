"""Access to polymorphic JSON (VARIANT) without failing on unexpected shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.text import strip


def path_of(*names: str) -> str:
    """JSON path through object keys; keys may hold blanks, dots and brackets."""
    return "$" + "".join("['" + name.replace("'", "\\'") + "']" for name in names)


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def child(value: Column, *names: str) -> Column:
    return F.try_variant_get(value, path_of(*names), "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    """Tests by a cast to an empty struct: variants inside the result would be copied, and `schema_of_variant` walks the whole document."""
    return get(value, "$", "struct<>").isNotNull()


def is_array(value: Column) -> Column:
    return get(value, "$", "array<struct<>>").isNotNull()


def is_string(value: Column) -> Column:
    """`schema_of_variant` only for what is no object or array, as it walks these."""
    return F.when(is_object(value) | is_array(value), F.lit(False)).otherwise(F.coalesce(kind(value) == "STRING", F.lit(False)))


def is_number(value: Column) -> Column:
    k = kind(value)
    return F.coalesce(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.lit(False))


def is_absent(value: Column) -> Column:
    """Missing key or JSON null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def string_of(value: Column) -> Column:
    """The text of a JSON string; null for every other kind."""
    return F.when(is_string(value), get(value, "$", "string"))


def number_of(value: Column) -> Column:
    """The value of a JSON number; null for every other kind."""
    return F.when(is_number(value), get(value, "$", "double"))


def first_truthy_text(value: Column, *names: str) -> Column:
    """First non-empty text among the named keys of an object, else ''."""
    texts = [F.nullif(get(value, path_of(name), "string"), F.lit("")) for name in names]
    return F.coalesce(*texts, F.lit(""))


def stripped_text(value: Column) -> Column:
    return strip(get(value, "$", "string"))


def values_of_key(json_text: Column, key: str) -> Column:
    """Distinct stripped scalar values of `key` (any letter case) at any depth of canonical JSON text.

    `json_text` must be the output of `to_json` on a VARIANT. There a key is the only place where an
    unescaped quote follows `{` or `,` and closes before a colon, so the pattern cannot match inside a
    string; possessive repeats keep the match linear on long strings. Objects, arrays and nulls do not
    count as values, but the search goes on inside them.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    scalar = r'[^\s,{}\[\]"]++'
    found = F.regexp_extract_all(
        json_text, F.lit(rf'(?<=[{{,])"(?i:{key})":({string}|{scalar})'), F.lit(1)
    )
    texts = F.transform(
        F.filter(found, lambda raw: raw != "null"),
        lambda raw: F.when(raw.isin("true", "false"), F.initcap(raw)).otherwise(
            strip(get(F.try_parse_json(raw), "$", "string"))
        ),
    )
    return F.array_distinct(F.filter(texts, lambda text: text != ""))
