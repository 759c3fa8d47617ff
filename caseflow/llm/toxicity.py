"""Toxicity by compression distance: separate zstandard dictionaries of toxic and ordinary text.

A bounded, hash-chosen sample of labelled texts trains the model. On two thirds of it Spark counts in how many toxic
and ordinary texts every word and word beginning occurs; words with a beginning that is significantly more
frequent in toxic texts are the sample text of the toxic dictionary, recurring other words that of the ordinary
one. A window is one word behind fixed common words, which keep zstandard's block overhead equal; its gain is
the difference of its compressed lengths under both dictionaries. The last third calibrates: a logistic model
over a text's distribution of gains, by length of word, and its own length turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.language import distinct_words, letter_runs, portions
from caseflow.scale import materialize

TRAIN_DOCS = 12_000
DICTIONARY_BYTES, LEVEL = 16_384, 12
# Least z-value of a toxic beginning, and its lengths in letters.
SIGNIFICANT, SHORTEST, LONGEST = 5.0, 4, 8
LOW, HIGH = -4, 9
# Letters of one window; longer runs of letters are several.
MAX_WORD = 40
# Word lengths in letters from which a new class begins: a byte saved on a short word says more.
LENGTHS = (1, 5, 7, 10)
SEED = 8


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    around: bytes
    weights: np.ndarray
    prior: float


def _beginnings(word: str) -> set[str]:
    return {word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)} | {word}


def _dictionary(words: list[str], weights: np.ndarray, size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary's content over samples of ten words, drawn by weight.

    Too little different text for the trainer is its own dictionary.
    """
    drawn = np.random.default_rng(SEED).choice(len(words), 60_000, p=weights / weights.sum())
    samples = [(" " + " ".join(words[i] for i in drawn[at : at + 10]) + " ").encode() for at in range(0, len(drawn), 10)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Plain content, so that both sides share zstandard's default tables and differ in matches only."""
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=settings)


class Scorer:
    """Gains of words and features of texts."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary, self.around = _compressor(model.toxic), _compressor(model.ordinary), model.around
        self.still = 0
        self.still = self.gain(b"")

    def gain(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a word, beyond what it saves on the words around it."""
        window = self.around + word + b" "
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window)) - self.still

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: shares of words by gain and length class, their roots, and the logarithm of the word count."""
        points, start, length, row = letter_runs(texts, MAX_WORD)
        bins = (HIGH - LOW + 1) * len(LENGTHS)
        table = np.zeros((len(texts), bins))
        if len(row):
            first, which = distinct_words(points, start, length)
            gains = np.array(
                [self.gain(points[start[i] : start[i] + length[i]].tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")) for i in first]
            )
            long = np.searchsorted(LENGTHS, length[first], "right") - 1
            place = (np.clip(gains, LOW, HIGH) - LOW) * len(LENGTHS) + long
            table = np.bincount(row * bins + place[which], minlength=len(texts) * bins).reshape(len(texts), bins).astype(float)
        count = np.maximum(table.sum(1, keepdims=True), 1)
        share = table / count
        return np.hstack([5 * np.sqrt(share), 20 * share, np.log(count) / 3, np.ones((len(texts), 1))])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on about `train_docs` labelled rows (label 0 or 1), chosen by a hash of the id.

    Rows with a null label are ignored, null texts count as empty. Where no beginning is significant, the dictionaries
    hold all words of the toxic and of the ordinary texts. Rows of one label only teach nothing but that share.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        F.col(id).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")
    )
    total = rows.count()
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(draw < min(1.0, train_docs / max(total, 1))).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(3)))
    chosen = materialize(chosen.dropDuplicates(["text", "label"]), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column(1))
            for at, texts in portions(batch.column(0)):
                points, start, length, row = letter_runs(texts, MAX_WORD)
                own: list[set[str]] = [set() for _ in texts]
                for s, n, r in zip(start, length, row, strict=True):
                    own[r].add(points[s : s + n].tobytes().decode("utf-32-le", "replace"))
                kinds, entries, toxic = [], [], []
                for r, found in enumerate(own):
                    parts = set().union(*map(_beginnings, found)) if found else set()
                    kinds += [0] * len(found) + [1] * len(parts)
                    entries += [*found, *parts]
                    toxic += [int(labels[at + r])] * (len(found) + len(parts))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(entries, pa.string()), pa.array(toxic, pa.int64())], ["kind", "entry", "toxic"])

    learn = chosen.filter("fold < 2")
    sizes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}  # two rows
    toxic_docs, ordinary_docs = sizes.get(1, 0), sizes.get(0, 0)
    known = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    prior = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1)
    plain = Model(b"", b"", b"", np.zeros(0), prior)
    if len(known) < 2:
        return plain
    if not toxic_docs or not ordinary_docs:  # the part that counts words has one label only
        learn = chosen
        toxic_docs, ordinary_docs = known[1], known[0]
    seen = learn.select("text", "label").repartition(spark.sparkContext.defaultParallelism)
    seen = seen.mapInArrow(count, "kind int, entry string, toxic bigint").groupBy("kind", "entry")
    seen = materialize(seen.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "entries")
    expected = (F.col("a") + F.col("b")) * (toxic_docs / (toxic_docs + ordinary_docs))
    strong = seen.filter((F.col("kind") == 1) & (F.col("a") >= 2) & (F.col("a") - expected > SIGNIFICANT * F.sqrt(expected)))
    marks = {r["entry"] for r in strong.select("entry").collect()}  # of a bounded sample
    listed = seen.filter("kind = 0 AND (a >= 1 OR b >= 2)").orderBy("entry").toArrow()  # likewise
    names, a, b = listed["entry"].to_pylist(), listed["a"].to_numpy(), listed["b"].to_numpy()
    marked = np.array([not marks.isdisjoint(_beginnings(w)) for w in names], bool)
    toxic, ordinary = np.flatnonzero(marked & (a > 0)), np.flatnonzero(~marked & (b > 1))
    if not len(toxic):  # nothing stands out: all words of the toxic texts speak for them
        toxic = np.flatnonzero(a > 0)
    if not len(ordinary):
        ordinary = np.flatnonzero(b > 0)
    if not len(toxic) or not len(ordinary):
        return plain  # one side has no words at all
    common = ordinary[np.argsort(-b[ordinary], kind="stable")[:3]]
    model = plain._replace(
        toxic=_dictionary([names[i] for i in toxic], a[toxic]),
        ordinary=_dictionary([names[i] for i in ordinary], b[ordinary]),
        around=(" " + " ".join(names[i] for i in common) + " ").encode(),
    )
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for at, texts in portions(batch.column(0)):
                x = scorer.features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array(list(x))], ["label", "x"])

    measured = chosen.select("text", "label", "fold")
    if measured.filter("fold = 2").select("label").distinct().count() == 2:
        measured = measured.filter("fold = 2")  # else too few rows to keep some apart
    fold = measured.select("text", "label").mapInArrow(measure, "label int, x array<double>").toArrow()  # of the bounded sample
    return model._replace(weights=_logistic(np.asarray(fold["x"].to_pylist()), fold["label"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(columns..., score): probability of the toxic label for every whole text.

    Null and empty texts get the score of a text without words. Repeated rows repeat in the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        scorer = Scorer(known) if len(known.weights) else None
        for batch in batches:
            for at, texts in portions(batch.column(len(columns))):
                p = np.full(len(texts), known.prior)
                if scorer is not None:
                    p = 1 / (1 + np.exp(-np.clip(scorer.features(texts) @ known.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), pa.array(p)], [*columns, "score"])

    return given.mapInArrow(run, schema)
