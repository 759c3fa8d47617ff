"""Prompt tables: text assembly, budgets, context of the previous round, merged samples.

Templates, examples and their wording are the caller's. Logs stay a column of their own until the prompt is
put together, so a prompt over budget is shortened by arithmetic on lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import let, render, truncate_middle
from caseflow.functions.variants import child

CASE = ["scenario", "case_idx"]
LOGS_PLACE = "semantic_labels"


def with_evidence(cases: DataFrame) -> DataFrame:
    """Add the evidence as text: logs_json, and rest_json with all other keys of `sem`.

    For cases of which several prompts are built: stored with these columns, they need `sem` no more, and no document is
    opened again for every role.
    """
    sem = F.col("sem")
    others = F.map_filter(F.try_variant_get(sem, "$", "map<string,variant>"), lambda k, _v: k != "anomaly_logs")
    return cases.withColumn("logs_json", F.to_json(child(sem, "anomaly_logs"))).withColumn("rest_json", F.coalesce(F.to_json(others), F.lit("{}")))


def evidence_columns(cases: DataFrame, drop_logs_for: str | None = vocab.NO_LOGS_SCENARIO) -> DataFrame:
    """Split `sem` into logs_json and rest_json, unless `with_evidence` has. One scenario's logs can be left out."""
    opened = with_evidence(cases) if "sem" in cases.columns else cases
    if drop_logs_for is None:
        return opened
    logs = F.col("logs_json")
    kept = F.when(F.col("scenario") == drop_logs_for, F.when(logs.isNotNull(), "{}")).otherwise(logs)
    return opened.withColumn("logs_json", kept)


def join_evidence(logs: Column, rest: Column) -> Column:
    """One JSON object of the logs (if any) and the other evidence."""
    tail = F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))
    return F.when(logs.isNull(), rest).otherwise(F.concat(F.lit('{"anomaly_logs":'), logs, tail))


def chars(text: Column) -> Column:
    """Default token counter: one character is one token."""
    return F.length(text)


# --- budget -----------------------------------------------------------------------------------
def cut_logs(head: Column, tail: Column, keep: Column, original: Column) -> Column:
    """JSON object with the first and last characters of an oversized log block, `keep` in all.

    `head` and `tail` are the block itself or long enough ends of it.
    """
    first = F.floor(keep / 2).cast("int")
    return F.to_json(
        F.struct(
            F.lit(True).alias("__truncated__"),
            F.lit(vocab.LOG_CUT_NOTE).alias("__note__"),
            original.alias("__original_token_count__"),
            F.left(head, first).alias("__head__"),
            F.right(tail, keep - first).alias("__tail__"),
        )
    )


def fit_logs(logs: Column, room: int | Column, count: Callable[[Column], Column] = chars) -> Column:
    """struct(text, retained): the largest head/tail cut of `logs` that fits into `room` tokens.

    Lengths grow with the kept part (JSON escapes included), so the largest fitting cut is found by
    halving inside the row. When not even the empty cut fits, it is returned with retained 0. With the
    default counter no more than `room` characters can stay, so the search only handles the two ends.
    """
    room = F.greatest(F.lit(room) if isinstance(room, int) else room, F.lit(0))
    most = F.greatest(F.length(logs) - 1, F.lit(0))
    if count is chars:
        most = F.least(most, room)
    ends = F.struct(F.left(logs, most).alias("head"), F.right(logs, most).alias("tail"), most.alias("most"), count(logs).alias("original"))

    def search(e: Column) -> Column:
        def halve(range_: Column, _i: Column) -> Column:
            low, high = range_["low"], range_["high"]
            middle = F.floor((low + high + 1) / 2).cast("int")
            fits = count(cut_logs(e["head"], e["tail"], middle, e["original"])) <= room
            return F.struct(
                F.when(fits, middle).otherwise(low).alias("low"),
                F.when(fits, high).otherwise(middle - 1).alias("high"),
            )

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(e["most"], F.lit(2)))).cast("int") + 1)
        start = F.struct(F.lit(0).alias("low"), e["most"].alias("high"))
        kept = F.aggregate(steps, start, halve)["low"]
        return let(kept, lambda k: F.struct(cut_logs(e["head"], e["tail"], k, e["original"]).alias("text"), k.alias("retained")))

    return let(ends, search)


def input_budget(model_length: int = vocab.MODEL_LENGTH, output: int = vocab.OUTPUT_TOKENS, safety: int = vocab.SAFETY_TOKENS) -> int:
    budget = model_length - output - safety
    if budget <= 0:
        raise ValueError(f"no room for input: {model_length} - {output} - {safety}")
    return budget


def fit_prompts(
    prompts: DataFrame,
    budget: int | None,
    *,
    before: str = "before",
    logs: str = "logs_json",
    after: str = "after",
    count: Callable[[Column], Column] = chars,
) -> DataFrame:
    """Put before + logs + after together within `budget` tokens.

    Over budget the logs shrink first, to head and tail; if that is not enough the whole prompt keeps head
    and tail around a marker. Adds prompt, original_tokens, final_tokens, truncated, truncation_strategy,
    retained_log_tokens. Without a budget nothing is cut.
    """
    if budget is None:
        full = F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in (before, logs, after)))
        return (
            prompts.withColumn("prompt", full)
            .withColumn("original_tokens", count(F.col("prompt")))
            .withColumn("final_tokens", F.col("original_tokens"))
            .withColumn("truncated", F.lit(False))
            .withColumn("truncation_strategy", F.lit("none"))
            .withColumn("retained_log_tokens", F.lit(None).cast("int"))
        )
    room = budget - len(vocab.PROMPT_CUT_MARK)
    if room <= 1:
        raise ValueError("the budget does not even hold the cut marker")
    b, l, a = (F.coalesce(F.col(c), F.lit("")) for c in (before, logs, after))
    sized = prompts.withColumn("_full", F.concat(b, l, a)).withColumn("original_tokens", count(F.col("_full")))
    over = F.col("original_tokens") > budget
    cuttable = over & F.col(logs).isNotNull() & (F.length(logs) > 0)
    rest = count(F.concat(b, a))
    sized = sized.withColumn("_cut", F.when(cuttable, fit_logs(l, F.lit(budget) - rest, count)))
    sized = sized.withColumn("_shrunk", F.when(F.col("_cut").isNotNull(), F.concat(b, F.col("_cut.text"), a)).otherwise(F.col("_full")))
    still = count(F.col("_shrunk")) > budget
    head = room // 2
    whole = F.concat(F.left("_shrunk", F.lit(head)), F.lit(vocab.PROMPT_CUT_MARK), F.right("_shrunk", F.lit(room - head)))
    return (
        sized.withColumn("prompt", F.when(still, whole).otherwise(F.col("_shrunk")))
        .withColumn("final_tokens", count(F.col("prompt")))
        .withColumn("truncated", over)
        .withColumn(
            "truncation_strategy",
            F.when(still, "whole_prompt_fallback").when(F.col("_cut").isNotNull(), "anomaly_logs").otherwise("none"),
        )
        .withColumn("retained_log_tokens", F.col("_cut.retained"))
        .drop("_full", "_cut", "_shrunk")
    )


def part(text: Column, is_log: bool = False) -> Column:
    """One piece of a prompt for `fit_parts`."""
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(is_log).alias("is_log"))


def fit_parts(prompts: DataFrame, budget: int, *, parts: str = "parts", count: Callable[[Column], Column] = chars) -> DataFrame:
    """Put the pieces of `parts`, an array of `part()` in reading order, together within `budget` tokens.

    Over budget the largest log block shrinks to the largest head and tail that fit, of equally large ones the later. If
    not even its empty cut is enough, it stays so and the next largest shrinks, and so on; blocks that are cut
    already are left alone. If all that is not enough, the whole prompt keeps head and tail around a marker. Adds the
    columns of `fit_prompts` and truncated_sections. The tokens of a prompt are those of its pieces together.
    """
    room = budget - len(vocab.PROMPT_CUT_MARK)
    if room <= 1:
        raise ValueError("the budget does not even hold the cut marker")
    sized = prompts.withColumn("_texts", F.transform(parts, lambda x: x["text"]))
    sized = sized.withColumn("_sizes", F.transform("_texts", lambda t: count(t).cast("bigint")))
    sized = sized.withColumn("original_tokens", F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda a, n: a + n))
    over = F.col("original_tokens") > budget

    def block(x: Column, i: Column) -> Column:
        usable = x["is_log"] & (F.length(x["text"]) > 0) & ~F.startswith(x["text"], F.lit('{"__truncated__":true'))
        return F.when(usable, F.struct((-F.get("_sizes", i)).alias("size"), (-i).alias("at")))

    blocks = F.array_sort(F.filter(F.transform(parts, block), lambda b: b.isNotNull()))
    start = F.struct(
        F.col("original_tokens").alias("total"), F.col("_texts").alias("texts"), F.lit(0).cast("bigint").alias("retained"), F.lit(0).alias("sections")
    )

    def shrink(state: Column, b: Column) -> Column:
        at = -b["at"]
        rest = state["total"] + b["size"]  # sizes are negative here

        def cut(c: Column) -> Column:
            return F.struct(
                (rest + count(c["text"])).cast("bigint").alias("total"),
                F.transform(state["texts"], lambda t, i: F.when(i == at, c["text"]).otherwise(t)).alias("texts"),
                (state["retained"] + c["retained"]).cast("bigint").alias("retained"),
                (state["sections"] + 1).alias("sections"),
            )

        return F.when(state["total"] <= budget, state).otherwise(let(fit_logs(F.get(state["texts"], at), F.lit(budget) - rest, count), cut))

    sized = sized.withColumn("_fit", F.when(over, F.aggregate(blocks, start, shrink)).otherwise(start))
    joined = F.array_join(F.col("_fit.texts"), "")
    head = room // 2
    whole = F.concat(F.left(joined, F.lit(head)), F.lit(vocab.PROMPT_CUT_MARK), F.right(joined, F.lit(room - head)))
    still = F.col("_fit.total") > budget
    return (
        sized.withColumn("prompt", F.when(still, whole).otherwise(joined))
        .withColumn("final_tokens", count(F.col("prompt")).cast("bigint"))
        .withColumn("truncated", over)
        .withColumn("truncation_strategy", F.when(still, "whole_prompt_fallback").when(F.col("_fit.sections") > 0, "anomaly_logs").otherwise("none"))
        .withColumn("retained_log_tokens", F.when(F.col("_fit.sections") > 0, F.col("_fit.retained")))
        .withColumn("truncated_sections", F.col("_fit.sections"))
        .drop("_texts", "_sizes", "_fit")
    )


# --- assembly ---------------------------------------------------------------------------------
def case_fields(cases: DataFrame) -> dict[str, Column]:
    """Template fields of a case table; extra columns of the table are fields too."""
    fields = {c: F.col(c) for c, kind in cases.dtypes if kind != "variant" and not kind.startswith(("array", "map", "struct"))}
    fields["alarm_type"] = F.col("scenario")
    if "candidates" in cases.columns:
        fields["root_cause_candidates"] = F.to_json("candidates")
    if "alarm_time_ms" in cases.columns:
        fields["alarm_time"] = F.col("alarm_time_ms").cast("bigint").cast("string")
    return fields


def build_prompts(
    cases: DataFrame,
    role: str,
    template: str,
    *,
    budget: int | None = None,
    extra: Mapping[str, Column] | None = None,
    examples: DataFrame | None = None,
    drop_logs_for: str | None = vocab.NO_LOGS_SCENARIO,
    count: Callable[[Column], Column] = chars,
) -> DataFrame:
    """Prompts of one role. `{semantic_labels}` in the template is the evidence with its logs.

    `examples` (scenario, text) appends a worked example to the cases of its scenario; with a column `parts` in place of
    `text`, an array of `part()`, its own log blocks shrink like those of the case. Only a stated `budget`, in
    tokens of `count`, cuts prompts; `input_budget()` gives that of a model.
    """
    subject = evidence_columns(cases, drop_logs_for)
    fields = {**case_fields(cases), **(extra or {})}
    place = "{" + LOGS_PLACE + "}"
    head, found, tail = template.partition(place)
    suffix = F.lit("")
    several = examples is not None and "parts" in examples.columns
    if several:
        subject = subject.join(examples.select("scenario", F.col("parts").alias("_example")), "scenario", "left")
    elif examples is not None:
        subject = subject.join(examples.select("scenario", F.col("text").alias("_example")), "scenario", "left")
        suffix = F.coalesce(F.concat(F.lit(vocab.EXAMPLE_LEAD), F.col("_example")), F.lit(""))
    has_logs = F.col("logs_json").isNotNull()
    rest = F.col("rest_json")
    opening = F.when(has_logs, F.lit('{"anomaly_logs":')).otherwise(rest) if found else F.lit("")
    closing = F.when(has_logs, F.when(rest == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))).otherwise("") if found else F.lit("")
    parts = (
        subject.withColumn("before", F.concat(render(head, fields), opening))
        .withColumn("after", F.concat(closing, render(tail, fields), suffix))
        .withColumn("_logs", F.col("logs_json") if found else F.lit(None).cast("string"))
    )
    if several and budget is not None:
        lead = F.when(F.col("_example").isNotNull(), F.concat(F.array(part(F.lit(vocab.EXAMPLE_LEAD))), F.col("_example")))
        own = F.array(part(F.col("before")), part(F.col("_logs"), True), part(F.col("after")))
        fitted = fit_parts(parts.withColumn("_parts", F.concat(own, F.coalesce(lead, F.slice(own, 1, 0)))), budget, parts="_parts", count=count)
    else:
        if several:
            shown = F.array_join(F.transform("_example", lambda x: x["text"]), "")
            parts = parts.withColumn("after", F.concat("after", F.coalesce(F.concat(F.lit(vocab.EXAMPLE_LEAD), shown), F.lit(""))))
        fitted = fit_prompts(parts, budget, logs="_logs", count=count)
    stats = ["original_tokens", "final_tokens", "truncated", "truncation_strategy", "retained_log_tokens"]
    return fitted.select(*CASE, F.lit(role).alias("role"), "prompt", *stats)


# --- context ----------------------------------------------------------------------------------
def truncate_answer(text: Column, max_chars: int = vocab.ANSWER_MAX_CHARS) -> Column:
    return truncate_middle(text, max_chars, vocab.ANSWER_CUT_MARK)


def round_context(meta: Column, reasoner: Column) -> Column:
    """Text of the previous round: the parts that exist, or the default line."""
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("[Last Meta]\n"), truncate_answer(meta)),
            F.concat(F.lit("[Last Reasoner]\n"), truncate_answer(reasoner)),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(vocab.NO_PREVIOUS_ROUND)


def with_round_context(rounds: DataFrame) -> DataFrame:
    """Add `last_round_outputs` to (scenario, case_idx, round, meta, reasoner); a case has few rounds."""
    window = Window.partitionBy(*CASE).orderBy("round")
    return rounds.withColumn("last_round_outputs", round_context(F.lag("meta").over(window), F.lag("reasoner").over(window)))


def merge_samples(responses: DataFrame, samples=tuple(s[0] for s in vocab.SAMPLERS)) -> DataFrame:
    """One text per case: the samples in sampler order with headers and rules.

    The samplers are a fixed short list, so each is one conditional maximum and nothing is collected.
    """
    texts = responses.groupBy(*CASE).agg(*[F.max(F.when(F.col("sample") == s, F.col("text"))).alias(f"_{i}") for i, s in enumerate(samples)])
    blocks = [F.concat(F.lit(f"=== {s} ===\n"), F.col(f"_{i}"), F.lit(f"\n\n{vocab.RULE}\n\n")) for i, s in enumerate(samples)]
    return texts.select(*CASE, F.concat(*[F.coalesce(b, F.lit("")) for b in blocks]).alias("text"))
