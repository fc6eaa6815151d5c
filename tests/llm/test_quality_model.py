"""The quality ranker piece by piece: features, loss gradient and cut against plain restatements."""

import math
import random

import numpy as np
import pytest

from rankloom.llm import quality as Q


def plain_features(text):
    """The features, one at a time, by counting."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    pairs = [(a, b) for a, b in zip(words, words[1:])]
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    often = lambda xs: max((xs.count(x) for x in set(xs)), default=0)
    chars_in = lambda ok: sum(1 for c in text if ok(c)) / chars
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
    plain = lambda c: c.isalnum() or c == "_" or c.isspace() or c in ".,;:!?'\"()-"
    return [
        math.log(1 + len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)),
        sum(x <= 2 for x in lengths) / len(lengths), sum(x >= 15 for x in lengths) / len(lengths),
        len(set(words)) / n, math.log(1 + len(set(words))) / math.log(1 + n), often(words) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(n - 1, 1), often(pairs) / n,
        len(set(lines)) / max(len(lines), 1), math.log(1 + len(lines)), math.log(1 + chars / max(len(lines), 1)),
        sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n,
        chars_in(lambda c: c in upper), chars_in(str.isdecimal), chars_in(lambda c: c == "!"),
        chars_in(lambda c: c in ",;:"), chars_in(lambda c: c in ".?"), chars_in(lambda c: c in "|/\\<>{}[]=_~^"),
        chars_in(lambda c: not plain(c)), sum(not w[-1].isalnum() for w in words) / n, len(text) / n]


def texts(count, seed=3):
    rng = random.Random(seed)
    some = ["The", "the", "AND", "a", "extraordinarily-long", "word.", "naïve,", "42", "x_y", "É!", "<b>", "$$", "日本語"]
    return ["", "\n\n", " ", "one"] + [
        "".join(rng.choice(some) + rng.choice([" ", " ", "\n", "\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(count)]


def test_features_are_what_they_say():
    for text in texts(60):
        assert Q.features(text) == pytest.approx(plain_features(text), abs=1e-12), repr(text)


def loss(w, good, bad, ridge):
    """Logistic loss over all preference pairs."""
    z = good @ w[:, None] - (bad @ w[:, None]).T
    return np.log1p(np.exp(-z)).mean() + ridge / 2 * (w @ w)


def test_weights_reach_the_least_loss_over_all_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (60, 4)), rng.normal(-0.2, 1, (50, 4))
    good[:, 3] = bad[0, 3] = 0.0
    ridge, w = 1e-2, np.zeros(4)
    for _ in range(4000):  # plain gradient descent over every pair
        p = 1 / (1 + np.exp(good @ w[:, None] - (bad @ w[:, None]).T))
        w = w + 0.5 * ((p.sum(1) @ good - p.sum(0) @ bad) / p.size - ridge * w)
    got = Q.bradley_terry(good, bad, ridge=ridge, rounds=1500, rate=0.01)
    assert loss(got, good, bad, ridge) < loss(w, good, bad, ridge) + 2e-3
    assert np.allclose(got, w, atol=0.12)
    step = 1e-5  # the descent itself stands still: its numeric gradient is zero
    slope = [(loss(w + step * e, good, bad, ridge) - loss(w - step * e, good, bad, ridge)) / (2 * step) for e in np.eye(4)]
    assert np.abs(slope).max() < 1e-4


@pytest.mark.parametrize("bad_share", [0.05, 0.3, 0.6])
def test_cut_is_the_quantile_of_the_bad_share(bad_share):
    some = texts(300, 9)
    labels = np.array([float(len(t.split()) > 25) for t in some])
    model = Q.fit(some, labels, bad_share, 0.3)
    scores = model.score(some)
    weight = np.where(labels == 0, bad_share / (labels == 0).sum(), (1 - bad_share) / (labels == 1).sum())
    below = weight[scores < 0.3].sum()  # the classes weigh as among all labelled rows
    assert abs(below - bad_share) <= weight[np.isclose(scores, 0.3, atol=0.02)].sum() + 2 * weight.max()
    pairs = scores[labels == 1][:, None] - scores[labels == 0][None, :]
    assert (pairs > 0).mean() > 0.95


def test_one_class_or_no_sample_scores_the_share_of_good():
    for labels, share in (([1.0, 1.0], 0.99), ([0.0, 0.0], 0.01), ([], 0.5)):
        model = Q.fit(["a", "b"][:len(labels)], np.array(labels), 0.2, 0.3)
        assert model.score(["", "any text"]) == pytest.approx([share, share])
