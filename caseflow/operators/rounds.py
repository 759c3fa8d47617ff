"""Routing of cases, batch model calls, and the two model flows as tables of prompts and responses.

No model is shipped: the caller gives a batch function `fn(prompts, sampler) -> answers`. Everything around
it (prompts, state, accounting) is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import is_blank
from caseflow.operators.prompts import build_prompts, chars, merge_samples, round_context, truncate_answer
from caseflow.scale import materialize, materialize_bucketed

CASE = ["scenario", "case_idx"]
BatchModel = Callable[[Sequence[str], dict], Sequence[str]]
Counter = Callable[[Column], Column]


# --- routing ----------------------------------------------------------------------------------
def route(cases: DataFrame) -> DataFrame:
    """Cases with an operating procedure go to competition, the others to cooperation."""
    return cases.withColumn("mode", F.when(is_blank(F.col("sop")), "cooperation").otherwise("competition"))


def stage_accounting(stages: Sequence[tuple[str, DataFrame]], final: str, keys=CASE) -> DataFrame:
    """Furthest stage per case and its status; only the final stage counts as processed.

    One combined aggregate over the union of the stage tables instead of a chain of joins.
    """
    marked = [df.select(*keys, F.lit(i).alias("at")) for i, (_name, df) in enumerate(stages)]
    names = F.array(*[F.lit(name) for name, _df in stages])
    furthest = reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.max("at").alias("at"))
    stage = F.get(names, F.col("at"))
    return furthest.select(
        *keys, stage.alias("stage"), F.when(stage == final, "processed").otherwise("skipped").alias("status")
    )


# --- model seam -------------------------------------------------------------------------------
def invoke(
    prompts: DataFrame,
    model: BatchModel,
    *,
    samplers: Sequence[tuple[str, float, float]] = (("single", 0.5, 0.9),),
    batch_size: int = vocab.BATCH_SIZE,
    partitions: int | None = None,
) -> DataFrame:
    """Call the model on every prompt with every sampler: (scenario, case_idx, sample, text, error).

    Prompts stream through the tasks in batches; a batch that raises, or is answered only in part, leaves null
    text for its missing answers, and the reason in `error`. `partitions` spreads the prompts over that many model workers.
    """
    options = F.array(
        *[F.struct(F.lit(n).alias("sample"), F.lit(t).alias("temperature"), F.lit(p).alias("top_p")) for n, t, p in samplers]
    )
    work = prompts.select(*CASE, "prompt", F.explode(options).alias("s")).select(*CASE, "prompt", "s.*")
    if partitions:
        work = work.repartition(partitions)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (sample, temperature, top_p), part in frame.groupby(["sample", "temperature", "top_p"], sort=False):
                texts, errors, asked = [], [], part["prompt"].tolist()
                for start in range(0, len(asked), batch_size):
                    batch = asked[start : start + batch_size]
                    failure = "no answer"
                    try:
                        answers = list(model(batch, {"sample": sample, "temperature": temperature, "top_p": top_p}))
                    except Exception as reason:
                        answers, failure = [], f"{type(reason).__name__}: {reason}"
                    answers = answers[: len(batch)] + [None] * (len(batch) - len(answers))
                    texts += answers
                    errors += [failure if a is None else None for a in answers]
                # One frame for all batches: a frame of one batch costs more than the batch.
                yield part[[*CASE, "sample"]].assign(text=pd.Series(texts, part.index, object), error=pd.Series(errors, part.index, object))

    return work.mapInPandas(call, "scenario string, case_idx bigint, sample string, text string, error string")


def failed_calls(answers: DataFrame) -> DataFrame:
    """Calls without an answer per sample and reason."""
    return answers.filter(F.col("error").isNotNull()).groupBy("sample", "error").agg(F.count(F.lit(1)).alias("calls"))


# --- flows ------------------------------------------------------------------------------------
def as_responses(answers: DataFrame, role: str, round_id: int | None = None) -> DataFrame:
    return answers.select(
        *CASE, F.lit(role).alias("role"), F.lit(round_id).cast("int").alias("round"), "sample", "text"
    )


def competition(
    cases: DataFrame, model: BatchModel, reasoner_template: str, verifier_template: str, *, budget: int | None = None, count: Counter = chars, **options
) -> tuple[DataFrame, DataFrame]:
    """Three samples per case, merged, then verified: (responses, accounting).

    `cases` is read by every stage and should be a stored table.

    `{reasoner_outputs}` in the verifier template is the merged text, cut in the middle when too long.
    """
    with_sop = cases.filter(~is_blank(F.col("sop")))
    prompts = build_prompts(with_sop, "competition", reasoner_template, budget=budget, count=count)
    samples = materialize(invoke(prompts, model, samplers=vocab.SAMPLERS, **options), "samples")
    complete = samples.groupBy(*CASE).agg(F.count("text").alias("n")).filter(F.col("n") == len(vocab.SAMPLERS))
    merged = merge_samples(samples).join(complete.select(*CASE), CASE, "left_semi")
    ready = with_sop.join(merged.withColumnRenamed("text", "reasoner_outputs"), CASE)
    ready = ready.withColumn("reasoner_outputs", truncate_answer(F.col("reasoner_outputs")))
    checked = materialize(invoke(build_prompts(ready, "verifier", verifier_template, budget=budget, count=count), model, **options), "verifier")
    responses = as_responses(samples, "competition").unionByName(as_responses(checked, "verifier"))
    accounting = stage_accounting(
        [("routed", cases), ("prepared", prompts), ("sampled", merged), ("verified", checked.filter(F.col("text").isNotNull()))],
        final="verified",
    )
    return responses, accounting


def stops(text: Column, marker: str = vocab.STOP_MARKER) -> Column:
    return F.coalesce(text.contains(marker), F.lit(False))


def with_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases that have an answer. With both sides bucketed by case no row moves."""
    return cases.join(answers, CASE)


def cooperation(
    cases: DataFrame,
    model: BatchModel,
    meta_template: str,
    reasoner_template: str,
    *,
    max_rounds: int = vocab.MAX_ROUNDS,
    budget: int | None = None,
    count: Counter = chars,
    marker: str = vocab.STOP_MARKER,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Meta and reasoner take turns until the stop marker or `max_rounds`: (responses, state).

    Each half round is one job over the cases still active, written to the shared folder; the driver only
    asks whether any case is left. The cases are stored once in buckets by case, and so are the answers of every half
    round, so that a half round joins them without moving the documents again. Meta sees `{last_round_outputs}`, the reasoner sees `{meta_output}`. A
    missing answer fails the case. `state` has rounds, stopped, failed, status per case.
    """
    blank = materialize_bucketed(cases.withColumn("sop", F.lit("")), "cases", CASE)
    active = blank.withColumn("last_round_outputs", F.lit(vocab.NO_PREVIOUS_ROUND))
    responses: list[DataFrame] = []
    for round_id in range(max_rounds):
        meta_prompts = build_prompts(active, "meta", meta_template, budget=budget, count=count, drop_logs_for=None)
        meta = materialize_bucketed(invoke(meta_prompts, model, **options), f"meta_{round_id}", CASE)
        responses.append(as_responses(meta, "meta", round_id))
        going = meta.filter(F.col("text").isNotNull() & ~stops(F.col("text"), marker))
        reasoning = with_answers(blank, going.select(*CASE, F.col("text").alias("meta_output")))
        answered = materialize_bucketed(
            invoke(build_prompts(reasoning, "reasoner", reasoner_template, budget=budget, count=count), model, **options), f"reasoner_{round_id}", CASE
        )
        responses.append(as_responses(answered, "reasoner", round_id))
        last = going.select(*CASE, F.col("text").alias("_meta")).join(
            answered.filter(F.col("text").isNotNull()).select(*CASE, F.col("text").alias("_reasoner")), CASE
        )
        if round_id + 1 == max_rounds or last.isEmpty():
            break
        active = with_answers(blank, last).withColumn("last_round_outputs", round_context(F.col("_meta"), F.col("_reasoner"))).drop("_meta", "_reasoner")
    all_responses = reduce(DataFrame.unionByName, responses)
    return all_responses, cooperation_state(cases, all_responses, marker)


def cooperation_state(cases: DataFrame, responses: DataFrame, marker: str = vocab.STOP_MARKER) -> DataFrame:
    """State of every case from its responses: completed rounds, first stopping round, failure."""
    meta, reasoner = F.col("role") == "meta", F.col("role") == "reasoner"
    seen = responses.groupBy(*CASE).agg(
        F.count_if(reasoner & F.col("text").isNotNull()).alias("rounds"),
        F.min(F.when(meta & stops(F.col("text"), marker), F.col("round"))).alias("stop_round"),
        F.coalesce(F.max(F.col("text").isNull()), F.lit(False)).alias("failed"),
    )
    known = cases.select(*CASE).join(seen, CASE, "left")
    failed = F.coalesce("failed", F.lit(True))
    return known.select(
        *CASE,
        F.coalesce("rounds", F.lit(0)).alias("rounds"),
        "stop_round",
        F.col("stop_round").isNotNull().alias("stopped"),
        failed.alias("failed"),
        F.when(failed, "skipped").otherwise("processed").alias("status"),
    )
