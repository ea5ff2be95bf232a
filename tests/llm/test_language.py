"""Paths over words against the plain search, words scored together against one by one, and what both cost."""

import random
import time

import numpy as np
import pytest

from glyphmill.llm import language


def _labeller(languages=4, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(languages):
        words = ["".join(rng.choices("abcdefgh"[k % 5 :] + "ijklmnop"[: k + 1], k=rng.randint(2, 9))) for _ in range(300)]
        rows += [(f"l{k}", " ".join(rng.choices(words, k=200))) for _ in range(5)]
    return language.Labeller(language.learn(rows)), rows


def _plain(scores):
    """The best path, word by word."""
    came, best, own = np.zeros(scores.shape, np.int64), scores[0].copy(), np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        top = int(best.argmax())
        stay = best >= best[top] - language.SWITCH
        came[t] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - language.SWITCH) + scores[t]
    out, at = np.empty(len(scores), np.int64), int(best.argmax())
    for t in range(len(scores) - 1, -1, -1):
        out[t] = at
        at = int(came[t, at])
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_paths_are_those_of_the_plain_search(monkeypatch, block):
    labeller, _ = _labeller()
    monkeypatch.setattr(language, "BLOCK", block)
    rng, several = np.random.default_rng(4), 0
    for n in (1, 2, 3, 7, 40, 300):
        for languages in (1, 2, 4, 9):
            for run in (1, 5, 20):
                scores = -6 * rng.random((n, languages)).round(1)
                scores[np.arange(n), np.repeat(rng.integers(0, languages, n), run)[:n]] = 0  # runs of one language; ties too
                path = labeller.path(scores)
                several += len(set(path.tolist())) > 1
                if languages > 1 and len(set(path.tolist())) > 1:
                    assert path.tolist() == _plain(scores).tolist()
                gain = lambda p: scores[np.arange(n), p].sum() - language.SWITCH * np.count_nonzero(np.diff(p))
                assert gain(path) >= gain(_plain(scores)) - 1e-9
    assert several > 10


def test_words_scored_together(monkeypatch):
    labeller, rows = _labeller()
    words = sorted({w for _, t in rows for w in t.split()}) + ["", "12", "река", "a", "река", "abc12", "(abc)", "x" * 5000]
    one = language.Labeller(labeller.m)
    single = [one.forms[language._letters(w)] for w in words]
    monkeypatch.setattr(language, "FORMS", 7)
    for _ in range(2):  # new, then remembered
        at = labeller.numbers(words)
        for name in ("rows", "lengths", "sums", "grams"):
            assert np.array_equal(getattr(labeller, name)[at], getattr(one, name)[single])
    assert labeller.forms == one.forms or len(labeller.forms) == len(one.forms)
    table = labeller.m.table[language._grams("abc")].sum(axis=0, dtype=np.float64)
    assert np.array_equal(labeller.sums[labeller.numbers(["abc"])[0]], table.astype(np.float32))


def test_mixed_texts_cost_little_more():
    labeller, _ = _labeller()
    rng = np.random.default_rng(6)
    scores = np.full((100_000, 4), -6.0)
    scores[np.arange(100_000), np.repeat(rng.integers(0, 4, 5000), 20)] = 0

    def cost(f):
        began = time.process_time()
        return f(scores).tolist(), time.process_time() - began

    (plain, slow), (path, fast) = cost(_plain), cost(labeller.path)
    assert path == plain and fast < slow / 2
