"""Feature selections out of model answers: extract, normalise, fall back, and feed back results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import before_think, embedded_json
from caseflow.functions.variants import child, get, is_absent, is_array, is_object, string_of

TOKENS = vocab.SEGMENT_TOKENS + vocab.STAT_TOKENS


def parse_answer(text: Column) -> dict[str, Column]:
    """cot (text before the first end-of-thinking tag) and the embedded JSON, null if unreadable."""
    return {"cot": before_think(text), "json": F.try_parse_json(embedded_json(text))}


def _opened(value: Column) -> Column:
    """JSON text inside JSON is parsed; other values stay."""
    return F.coalesce(F.try_parse_json(string_of(value)), value)


def _record(value: Column) -> Column:
    """The selection in an object: itself, or the object under its key `json`."""
    own = child(value, "log").isNotNull() & child(value, "kpi").isNotNull()
    inner = child(value, "json")
    nested = child(inner, "log").isNotNull() & child(inner, "kpi").isNotNull()
    return F.when(own, value).when(nested, inner)


def first_selection(value: Column) -> Column:
    """First object with both `log` and `kpi` in depth-first order, through any number of nested lists."""
    def open_lists(items: Column, _level: Column) -> Column:
        opened = F.transform(
            items, lambda v: F.when(is_array(v), F.transform(get(v, "$", "array<variant>"), _opened)).otherwise(F.array(v))
        )
        return F.when(F.exists(items, is_array), F.flatten(opened)).otherwise(items)

    # A value cannot nest deeper than it has opening brackets, those inside JSON text included.
    brackets = F.coalesce(F.length(F.regexp_replace(F.to_json(value), r"[^\[]", "")), F.lit(0))
    levels = F.slice(F.sequence(F.lit(1), F.greatest(brackets, F.lit(1))), F.lit(1), brackets)
    items = F.aggregate(levels, F.array(_opened(value)), open_lists)
    return F.get(F.filter(F.transform(items, _record), lambda r: r.isNotNull()), F.lit(0))


def normalise_log(raw: Column) -> Column:
    """A text becomes a list; an empty or odd value becomes the default; first occurrences stay."""
    items = F.when(is_array(raw), get(raw, "$", "array<string>")).otherwise(
        F.when(string_of(raw).isNotNull(), F.array(string_of(raw)))
    )
    return F.when(F.size(items) > 0, F.array_distinct(items)).otherwise(F.array(F.lit(vocab.TEMPLATE_COUNTS)))


def normalise_tokens(raw: Column) -> Column:
    """Allowed tokens in order; `mix` and `mean` are added when no segment / statistic is named."""
    items = F.when(is_array(raw), get(raw, "$", "array<string>")).otherwise(
        F.when(~is_absent(raw), F.array(get(raw, "$", "string")))
    )
    items = F.coalesce(items, F.array().cast("array<string>"))
    kept = F.array_distinct(F.filter(items, lambda t: t.isin(*TOKENS)))

    def lacks(tokens) -> Column:
        return ~F.arrays_overlap(kept, F.array(*[F.lit(t) for t in tokens]))

    none = F.array().cast("array<string>")
    return F.concat(
        kept,
        F.when(lacks(vocab.SEGMENT_TOKENS), F.array(F.lit("mix"))).otherwise(none),
        F.when(lacks(vocab.STAT_TOKENS), F.array(F.lit("mean"))).otherwise(none),
    )


def normalise(record: Column) -> Column:
    """struct(log, kpi) of a selection object; null when the object is null."""
    kpis = []
    for name in vocab.KPIS:
        kpis += [F.lit(name), normalise_tokens(child(record, "kpi", name))]
    return F.when(
        record.isNotNull(),
        F.struct(normalise_log(child(record, "log")).alias("log"), F.create_map(*kpis).alias("kpi")),
    )


def selections_from_answers(answers: DataFrame, keys=("scenario",), order: str = "pos") -> DataFrame:
    """One normalised selection per key: the first answer by `order` that holds one; null if none does.

    The earliest usable record is found by a map-side combined aggregate.
    """
    record = first_selection(parse_answer(F.col("text"))["json"])
    found = answers.select(*keys, order, record.alias("record"))
    usable = F.when(F.col("record").isNotNull(), F.col(order))
    firsts = found.groupBy(*keys).agg(F.min_by(F.to_json("record"), usable).alias("_json"))
    return firsts.select(*keys, normalise(F.try_parse_json("_json")).alias("selection"))


def with_fallback(new: DataFrame, previous: DataFrame, keys=("scenario",)) -> DataFrame:
    """Use the previous selection where the new one is missing; `fallback_reason` says so."""
    joined = previous.select(*keys, F.col("selection").alias("_previous")).join(new, list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("selection", "_previous").alias("selection"),
        F.when(F.col("selection").isNull(), F.lit("no valid selection in the answer")).alias("fallback_reason"),
    )


def feedback_cases(
    results: DataFrame,
    keys=("scenario", "stage"),
    order: str = "case_idx",
    wrong: int = vocab.WRONG_CASES,
    correct: int = vocab.CORRECT_CASES,
) -> DataFrame:
    """First wrong and first correct cases per run, for the next selection round.

    The rank filter lets Spark keep only the leading rows of each group before the shuffle.
    """
    judged = results.filter(F.col("is_correct").isNotNull())
    window = Window.partitionBy(*keys, "is_correct").orderBy(order)
    ranked = judged.withColumn("feedback_pos", F.row_number().over(window)).filter(
        F.col("feedback_pos") <= max(wrong, correct)
    )
    limit = F.when(F.col("is_correct"), F.lit(correct)).otherwise(F.lit(wrong))
    return ranked.filter(F.col("feedback_pos") <= limit)


def important_features(features: Column, limit: int = vocab.FEATURES_PER_CASE) -> Column:
    """Largest non-zero entries of a feature map by absolute value, then name."""
    entries = F.filter(F.map_entries(features), lambda e: e["value"] != 0)
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("name"), e["value"].alias("value"))))
    return F.transform(F.slice(ordered, 1, limit), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def feedback_summary(results: DataFrame, keys=("scenario", "stage"), details: DataFrame | None = None, **limits) -> DataFrame:
    """One JSON summary per run: accuracy plus the feedback cases (at most ten, so the list is bounded).

    With `details`, one row per feedback case (keys, case_idx) with what is shown of it, `results` needs only keys, case_idx
    and is_correct, so that predictions and features are not stored for every case.
    """
    cases = feedback_cases(results, keys, **limits)
    if details is not None:
        narrow = cases.select(*keys, "case_idx", "is_correct", "feedback_pos")
        cases = narrow.join(details.select(*[c for c in details.columns if c not in ("is_correct", "feedback_pos")]), [*keys, "case_idx"])
    shown = F.struct(
        *[c for c in ("case_idx", "groundtruth", "pred_top1_rc", "pred_rc", "cot", "rank") if c in cases.columns],
        *([important_features(F.col("features")).alias("important_nonzero_features")] if "features" in cases.columns else []),
    )
    def in_order(rows: Column) -> Column:  # by position alone: a case holds maps, which have no order
        return F.array_sort(F.collect_list(rows), lambda a, b: a["feedback_pos"] - b["feedback_pos"])

    case = F.struct("feedback_pos", shown.alias("case"))
    listed, listed_ok = in_order(F.when(~F.col("is_correct"), case)), in_order(F.when(F.col("is_correct"), case))
    lists = cases.groupBy(*keys).agg(
        F.transform(listed, lambda x: x["case"]).alias("wrong_cases"),
        F.transform(listed_ok, lambda x: x["case"]).alias("correct_cases"),
    )
    totals = results.groupBy(*keys).agg(
        F.count("is_correct").alias("labeled_total"),
        F.count_if("is_correct").alias("correct"),
        F.avg(F.col("is_correct").cast("int")).alias("accuracy"),
    )
    return totals.join(lists, list(keys), "left").withColumn(
        "summary", F.to_json(F.struct("labeled_total", "correct", "accuracy", "wrong_cases", "correct_cases"))
    )
