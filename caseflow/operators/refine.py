"""Selections refined over rounds: trees, their summary, the next answer, and a state that is carried along.

Every round trains the trees of all scenarios under their present selection, sums the results up, renders one prompt per
scenario with the selection and the summary, and takes the next selection from the answers. The state is a table with
one row per (scenario, round); it is written after each round, so the plan does not grow with the rounds and a lost
executor does not start the loop anew.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import render
from caseflow.operators import features as feat
from caseflow.operators import selection as sel
from caseflow.operators import tree
from caseflow.scale import materialize

# Template fields besides the scenario's own (alarm_type, round).
PREVIOUS, SUMMARY = "previous_selection", "validcase_summary"


class Refined(NamedTuple):
    """`state`: scenario, round, selection, summary, labeled_total, correct, accuracy, fallback_reason, stopped.

    `selections`: the last selection per scenario. `prompts`: scenario, round, prompt, as they were asked.
    """

    state: DataFrame
    selections: DataFrame
    prompts: DataFrame


def refiner_prompts(carried: DataFrame, template: str) -> DataFrame:
    """(scenario, round, prompt) from the selection and summary of a round."""
    fields = {
        "alarm_type": F.col("scenario"),
        "round": F.col("round").cast("string"),
        PREVIOUS: F.to_json("selection"),
        SUMMARY: F.coalesce("summary", F.lit("{}")),
    }
    return carried.select("scenario", "round", render(template, fields).alias("prompt"))


def refine(
    train: DataFrame,
    infer: DataFrame,
    first: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    template: str,
    *,
    rounds: int = 1,
    stop_at: float | None = None,
    label: str = "root_cause",
    max_depth: int = vocab.MAX_DEPTH,
    min_leaf: int = vocab.MIN_SAMPLES_LEAF,
) -> Refined:
    """Refine the selections `first` (scenario, selection) over `rounds` answers.

    `train` and `infer` have scenario, idx, sem and `label`. `ask` maps (scenario, round, prompt) to answers (scenario, pos,
    text); a scenario without a usable answer keeps its selection and says so in `fallback_reason`. With `stop_at` a
    scenario whose accuracy reaches it is stopped: it is neither trained nor asked again. Scenarios of `first`
    without train rows have no summary. The last round's selection is in `selections`; training under it is the caller's.
    """
    # Documents are opened once: a selection only switches features off.
    keep = ("scenario", "idx", label)
    known, names = feat.all_values(train.select(*keep, "sem"), keep)
    known = materialize(known, "train_values")
    asked_for = materialize(feat.all_values(infer.select(*keep, "sem"), keep)[0], "infer_values")
    current = materialize(first.select("scenario", "selection"), "selections")
    done, asked, finished = [], [], None
    for number in range(rounds):
        chosen = current.select("scenario", "selection.log", "selection.kpi")

        def selected(values: DataFrame, chosen: DataFrame = chosen, going: DataFrame = current) -> DataFrame:
            return feat.switched_values(values.join(going.select("scenario"), "scenario", "left_semi"), chosen, keep)

        predictions, nodes = tree.run(
            selected(known), selected(asked_for), ["scenario"], names, label=label, max_depth=max_depth, min_leaf=min_leaf
        )
        # Every case is judged, but only the few of the summary need their ranking, path and features.
        results = materialize(predictions.select("scenario", F.col("idx").alias("case_idx"), "is_correct"), "results")
        feedback = materialize(sel.feedback_cases(results, ["scenario"]), "feedback")
        few = asked_for.join(feedback.select("scenario", F.col("case_idx").alias("idx")), ["scenario", "idx"], "left_semi")
        detailed = tree.predict(selected(few), nodes, ["scenario"], names, depth=max_depth, truth=label)
        # The arrays hold a value for every feature; the summary shows the few that are not zero.
        shown = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("features"))
        detailed = materialize(detailed.withColumns({"case_idx": F.col("idx"), "groundtruth": F.col(label), "features": shown}), "detailed")
        summary = sel.feedback_summary(results, ["scenario"], detailed).select("scenario", "labeled_total", "correct", "accuracy", "summary")
        carried = current.withColumn("round", F.lit(number)).join(summary, "scenario", "left")
        reached = F.coalesce(F.col("accuracy") >= stop_at, F.lit(False)) if stop_at is not None else F.lit(False)
        carried = materialize(carried.withColumn("stopped", reached), "carried")
        going = carried.filter("NOT stopped")
        prompts = materialize(refiner_prompts(going, template), "prompts")
        answers = ask(prompts)
        merged = materialize(sel.with_fallback(sel.selections_from_answers(answers), going.select("scenario", "selection")), "merged")
        done.append(carried.join(merged.select("scenario", "fallback_reason"), "scenario", "left"))
        asked.append(prompts)
        stopped = carried.filter("stopped").select("scenario", "selection")
        finished = stopped if finished is None else finished.unionByName(stopped)
        current = merged.select("scenario", "selection")
        if current.isEmpty():
            break
    if not done:
        raise ValueError("rounds must be positive")
    state, prompts = done[0], asked[0]
    for more, texts in zip(done[1:], asked[1:], strict=True):
        state, prompts = state.unionByName(more), prompts.unionByName(texts)
    return Refined(materialize(state, "state"), finished.unionByName(current), prompts)
