"""Language model over long pieces and long runs of letters."""

from __future__ import annotations

import base64
import math

import numpy as np

from caseflow.llm import language


def log_sum(model, word, k):
    """Log-probability of a word by a plain recursion over its prefixes."""
    prefix = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        state = 0
        for j in range(i, len(word)):
            state = model.step(state, word[j])
            if model.terminal[state]:
                prefix[j + 1] = np.logaddexp(prefix[j + 1], prefix[i] + math.log(model.p[state, k]))
    return prefix[-1]


def model_of(pieces, low=1e-9):
    model = language.Lattice(pieces, ["x", "y"])
    spread = np.random.default_rng(1).random(model.p.shape) ** 6 + low
    model.p = np.where(model.terminal[:, None], spread / spread.sum(0) / 10, 0)
    return model


def test_long_pieces_of_the_vocabulary_stay(tmp_path):
    path = tmp_path / "pieces"
    path.write_text("".join(f"{base64.b64encode(p.encode()).decode()} {i}\n" for i, p in enumerate([" nevertheless", "the"])))
    assert "nevertheless" in language.pieces(str(path), set("nevrthls"))


def test_runs_of_letters_are_not_cut():
    model = model_of(["a", "b", "ab", "ba", "abbabaabbaab", "babbabaabbaababba"])
    texts = ["ab" * 60, "abbabaabbaab" * 40 + "ж" * 400, "a", "ab " + "babbabaabbaababba" * 3]
    logs, words = language.log_likelihoods(model, texts)
    assert list(words) == [1, 1, 1, 2]
    want = [[sum(log_sum(model, w, k) for w in t.split()) for k in (0, 1)] for t in texts]
    assert np.isfinite(logs).all() and np.allclose(logs, want, rtol=1e-9)


def test_expected_counts_of_a_long_run():
    model = model_of(["a", "b", "ab", "abbabaabbaab"])
    model.p[model.terminal] *= 1e-6  # plain products would be 0
    word = "abbabaabbaab" * 12
    points, start, length, _ = language.letter_runs([word])
    ((_, codes),) = language.by_length(points, start, length, model.symbols)
    expected = model.expected(codes, np.array([2.0]), 1)
    for state in np.flatnonzero(model.terminal):
        before = log_sum(model, word, 1)
        model.p[state, 1] *= 1 + 1e-6
        assert abs(2 * (log_sum(model, word, 1) - before) / 1e-6 - expected[state]) < 1e-2 * max(1, expected[state])
        model.p[state, 1] /= 1 + 1e-6


def test_sparse_edges_are_those_of_a_dense_table():
    rng = np.random.default_rng(3)
    dense = np.ones((500, 900), np.int32)
    at = rng.choice(500 * 900, 3000, replace=False)
    dense[at // 900, at % 900] = rng.integers(2, 500, 3000)
    edges = language.Edges(at // 900, at % 900, dense[at // 900, at % 900])
    state, symbol = np.divmod(np.arange(500 * 900), 900)
    assert (edges.follow(state, symbol) == dense[state, symbol]).all()
    empty = language.Edges(*np.zeros((3, 0), np.int64))
    assert (empty.follow(state, symbol) == 1).all()


def test_many_letters_make_a_small_model():
    letters = {chr(c) for c in range(0x4E00, 0x4E00 + 19_000)} | {chr(c) for c in range(0xAC00, 0xAC00 + 11_000)} | set("abcdefghij")
    model = language.Lattice(language.pieces(language.VOCABULARY, letters), ["x", "y"])
    size = sum(x.nbytes for x in (model.symbols, model.p, model.terminal, model.edges.keys, model.edges.to))
    assert len(model.terminal) > 30_000 and size < 50 << 20
    assert model.step(0, chr(0x4E00)) > 1 and model.symbols.max() == len(letters)


def test_rare_letters_are_in_the_alphabet(spark):
    rows = [(i, "abc " * 20 + ("ж" if i == 0 else ""), "x") for i in range(30)] + [(i, "bca " * 20, "y") for i in range(30, 60)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.symbols[ord("ж")] > 0
