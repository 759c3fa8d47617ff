"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary; only their probabilities are learned, one set per language. The
probability of a word is the sum over all its segmentations into pieces, computed by a forward recursion, and a text
is the product of its words (runs of letters, lower-cased). Training runs expectation maximisation
over the word counts of a bounded sample; the expected piece counts of all segmentations are summed in Spark.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.textblocks import rolling_words
from caseflow.scale import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TRAIN_DOCS, ROUNDS, SMOOTH = 1500, 2, 0.1
# Positions between two rescalings of prefix sums, and letters of words of one length handled at once.
STRIDE, CELLS = 8, 1 << 20
# Characters handled at once.
CHARS = 4 << 20

_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def pieces(path: str, alphabet: set[str]) -> list[str]:
    """Letter pieces of the vocabulary over an alphabet, lower-cased, without word marks."""
    found = set(alphabet)
    with open(path, "rb") as lines:
        for line in lines:
            try:
                piece = base64.b64decode(line.split()[0]).decode().strip().lower()
            except UnicodeDecodeError:
                continue  # a part of a character
            if piece and set(piece) <= alphabet:
                found.add(piece)
    return sorted(found)


class Edges:
    """Trie edges (state, symbol) -> state in an open hash table, whose size follows the edges and not the alphabet."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        self.mask = (1 << max(int(8 * len(state)).bit_length(), 4)) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.to = np.ones(self.mask + 1, np.int32)
        key = state.astype(np.int64) << 32 | symbol.astype(np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):  # of the edges that meet at a free slot the first takes it, the others go on to the next slot
            free = self.keys[slot] == -1
            taken, first = np.unique(slot[free], return_index=True)
            winners = left[free][first]
            self.keys[taken], self.to[taken] = key[winners], to[winners]
            stay = self.keys[slot] != key[left]
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self.mask

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; 1 where there is no edge."""
        key = state.astype(np.int64) << 32 | symbol.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.to[slot], 1).astype(np.int32)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Lattice:
    """Piece trie, and piece probabilities per trie state and language.

    State 0 is the root and state 1 is dead. Characters outside the alphabet are one extra symbol, 0, which is a
    piece of its own, so every word has a segmentation.
    """

    def __init__(self, vocabulary: list[str], languages: list[str]):
        self.languages = languages
        alphabet = sorted({c for p in vocabulary for c in p})
        self.longest = max(map(len, vocabulary), default=1)
        self.symbols = np.zeros(0x110000, np.int32)
        self.symbols[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        rows: list[dict[int, int]] = [{}, {}]
        ends = [0, 0]
        for symbols in [[0]] + [[int(self.symbols[ord(c)]) for c in p] for p in vocabulary]:
            state = 0
            for s in symbols:
                if s not in rows[state]:
                    rows[state][s] = len(rows)
                    rows.append({})
                    ends.append(0)
                state = rows[state][s]
            ends[state] = 1
        edges = [(state, s, to) for state, row in enumerate(rows) for s, to in row.items()]
        self.edges = Edges(*np.array(edges, np.int64).reshape(-1, 3).T)
        self.terminal = np.asarray(ends, bool)
        n = int(self.terminal.sum())
        self.p = np.where(self.terminal[:, None], 1.0 / n, 0.0).repeat(len(languages), 1)
        self.prior = np.full(len(languages), 1.0 / max(len(languages), 1))

    def step(self, state: int, letter: str) -> int:
        """The state behind one letter."""
        return int(self.edges.follow(np.array([state]), self.symbols[[ord(letter)]])[0])

    def _steps(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words, states) of the pieces that start at position i, with the words such a piece goes on in."""
        own, state = np.arange(len(codes)), np.zeros(len(codes), np.int32)
        for j in range(i, min(i + self.longest, codes.shape[1])):
            state = self.edges.follow(state, codes[own, j])
            alive = state != 1
            if not alive.all():
                own, state = own[alive], state[alive]
            if not len(own):
                return
            yield j + 1, own, state

    def _scaled(self, codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix probabilities (word, position, language) of words of one length, as multiples of the exponentials
        (position // STRIDE, word, language).

        Every STRIDE positions what is open is divided by its largest value, so words of any length keep their digits.
        """
        n = codes.shape[1]
        alpha = np.zeros((len(codes), n + 1, p.shape[1]))
        alpha[:, 0] = 1
        logs = np.zeros((n // STRIDE + 1, len(codes), p.shape[1]))
        for i in range(n + 1):
            if i and i % STRIDE == 0:
                open_ = alpha[:, i : i + self.longest]
                top = open_.max(1)
                open_ /= top[:, None]
                logs[i // STRIDE] = logs[i // STRIDE - 1] + np.log(top)
            for end, own, state in self._steps(codes, i):
                alpha[own, end] += alpha[own, i] * p[state]
        return alpha, logs

    def forward(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Prefix probabilities (word, position, language) of words of one length; of long words they may be 0."""
        alpha, logs = self._scaled(codes, p)
        return alpha * np.exp(logs[np.arange(alpha.shape[1]) // STRIDE]).swapaxes(0, 1)

    def log_words(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log-probabilities (word, language) of words of one length."""
        alpha, logs = self._scaled(codes, p)
        return np.log(alpha[:, -1]) + logs[-1]

    def expected(self, codes: np.ndarray, counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of every state's piece over all segmentations of the words."""
        p = self.p[:, [language]]
        n = codes.shape[1]
        alpha, logs = self._scaled(codes, p)
        alpha, logs = alpha[:, :, 0], logs[np.arange(n + 1) // STRIDE, :, 0].T
        with np.errstate(divide="ignore"):
            log_p, begins = np.log(p[:, 0]), np.log(alpha) + logs
        ends = np.where(alpha > 0, begins, np.inf)
        # How often a segmentation has a border at a position; a border's pieces share it by their prefixes.
        border = np.zeros((len(codes), n + 1))
        border[:, n] = 1
        total = np.zeros(len(self.p))
        for i in reversed(range(n)):
            for end, own, state in self._steps(codes, i):
                share = border[own, end] * np.exp(begins[own, i] + log_p[state] - ends[own, end])
                border[own, i] += share
                total += np.bincount(state, counts[own] * share, len(total))
        return total

    def update(self, totals: np.ndarray) -> None:
        smoothed = np.where(self.terminal[:, None], totals + SMOOTH, 0.0)
        self.p = smoothed / smoothed.sum(0)


def by_length(points: np.ndarray, start: np.ndarray, length: np.ndarray, symbols: np.ndarray, step: int = 1 << 15):
    """(word indices, code matrix) for words of equal length, at most `step` words and about CELLS letters at a time."""
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for same in np.split(order, cuts) if len(order) else ():
        rows = min(step, max(1, CELLS // max(1, int(length[same[0]]))))
        for at in range(0, len(same), rows):
            own = same[at : at + rows]
            yield own, symbols[points[start[own][:, None] + np.arange(length[own[0]])]]


def letter_runs(texts: list[str], longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and start, length and text of every word.

    With `longest`, a longer run of letters counts as several words of that length.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = is_letter()[points]
    start, end = np.flatnonzero(letter[1:-1] & ~letter[:-2]), np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    if longest is not None:
        parts = -(-(end - start) // longest)
        base = np.repeat(start, parts) + longest * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        start, end = base, np.minimum(base + longest, np.repeat(end, parts))
    return points, start, end - start, np.searchsorted(bounds, start, "right") - 1


def portions(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about CHARS characters; null is empty."""
    first, texts, size = 0, [], 0
    for i, text in enumerate(column.to_pylist()):
        texts.append(text or "")
        size += len(text or "")
        if size >= CHARS:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def distinct_words(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every distinct word, and the distinct word of every word."""
    _, first, which = np.unique(rolling_words(points, start, length), return_index=True, return_inverse=True)
    return first, which


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", train_docs: int = TRAIN_DOCS, path: str = VOCABULARY) -> Lattice:
    """Piece probabilities from at most about `train_docs` documents per language, chosen by a hash of the id.

    Every letter of these documents is in the alphabet. `path` is a vocabulary file of a public tokenizer, one base64
    piece and its rank per line; without that file training fails with FileNotFoundError.
    """
    spark = docs.sparkSession
    usable = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    found = usable.groupBy("lang").count().orderBy("lang").collect()  # one row per language
    languages = [r["lang"] for r in found]
    share = F.create_map(*(F.lit(x) for r in found for x in (r["lang"], min(1.0, train_docs / r["count"])))) if found else F.lit(None)
    if not found:
        return Lattice([], [])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.filter(draw < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tongues = np.asarray(batch.column(1).to_pylist(), object)
            for at, texts in portions(batch.column(0)):
                points, start, length, row = letter_runs(texts)
                for tongue in sorted(set(tongues[at : at + len(texts)])):
                    own = np.flatnonzero(tongues[at + row] == tongue)
                    if not len(own):
                        continue
                    first, which = distinct_words(points, start[own], length[own])
                    body = [points[start[own[i]] : start[own[i]] + length[own[i]]].tobytes().decode("utf-32-le", "surrogatepass") for i in first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tongue] * len(body), pa.string()), pa.array(body, pa.string()), pa.array(np.bincount(which))], ["lang", "word", "n"]
                    )

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint")
    counted = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    letters = counted.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct()
    alphabet = {r["c"] for r in letters.collect()}  # at most the letters of Unicode
    model = Lattice(pieces(path, alphabet), languages)
    place = {name: i for i, name in enumerate(languages)}
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)  # a public vocabulary's letter pieces over the sample's alphabet

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, totals = sent.value, np.zeros_like(sent.value.p)
            for batch in batches:
                tongues = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                texts, counts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                length = np.array([len(t) for t in texts], np.int64)
                start = np.cumsum(length) - length
                for k in np.unique(tongues):
                    own = np.flatnonzero(tongues == k)
                    for words, codes in by_length(points, start[own], length[own], lattice.symbols):
                        totals[:, k] += lattice.expected(codes, counts[own[words]], k)
            state, k = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(state, pa.int32()), pa.array(k, pa.int32()), pa.array(totals[state, k])], ["state", "k", "n"])

        sums = counted.mapInArrow(expect, "state int, k int, n double").groupBy("state", "k").agg(F.sum("n").alias("n")).toArrow()
        totals = np.zeros_like(model.p)  # vocabulary times languages
        totals[sums["state"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
        model.update(totals)
    return model


def log_likelihoods(lattice: Lattice, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, language) log-probabilities of whole texts, and their word counts."""
    points, start, length, row = letter_runs(texts)
    words = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    out = np.zeros((len(texts), len(lattice.languages)))
    if len(row) and len(lattice.languages):
        first, which = distinct_words(points, start, length)
        logs = np.zeros((len(first), len(lattice.languages)))
        for own, codes in by_length(points, start[first], length[first], lattice.symbols):
            logs[own] = lattice.log_words(codes, lattice.p)
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(row, logs[which, k], len(texts))
    return out, words


def identify(docs: DataFrame, lattice: Lattice, text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(columns..., lang_pred, score): the likeliest language of every whole text and its posterior probability.

    Null texts, texts without a letter and models without languages give `und` with score 0; ties go to the
    first language by name. Repeated rows repeat in the result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lattice)
    given = docs.select(*columns, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at, texts in portions(batch.column(len(columns))):
                logs, words = log_likelihoods(model, texts)
                known = (words > 0) & (len(model.languages) > 0)
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if len(model.languages):
                    logs = logs + np.log(model.prior)
                    best = logs.argmax(1)
                    score = 1 / np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700)).sum(1)
                tongues = [model.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                own = [c.slice(at, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(tongues, pa.string()), pa.array(np.where(known, score, 0.0))], [*columns, "lang_pred", "score"]
                )

    return given.mapInArrow(run, schema)


def held_out(id: str, parts: int, left: int) -> Column:
    """Rows kept from learning: crc32 of the id as text modulo `parts` is `left`."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == left, F.lit(False))
