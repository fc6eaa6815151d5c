"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are labelled from document labels: a token of a toxic document is toxic
if its form or one of its beginnings stands in many toxic and hardly any clean
documents of the sample. A two-label CRF (hashed word, prefix, suffix and shape
features; transitions; sentences as chains) learns these labels; the marginals
of the forward-backward recursions over the whole text give the offending
offsets, and their sum, maximum and share give the document score by a logistic
fit on texts that the chain has not seen.

The model is fitted in one task on a bounded sample of labelled rows
(``max_per_class``); every row is scored by it, in any order.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import replace
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankloom.llm.common import labelled_sample, slices, worker_cache
from rankloom.llm.words import Words, scan

BUCKETS = 1 << 18
CACHE_FORMS = 400_000
MAX_PER_CLASS = 1000
SPAN_LEVEL = 0.5
MIN_SHARE, MIN_LIFT = 0.025, 25.0  # of the token labels; rarer or less telling words of toxic texts are not learnt
LONG_CHAIN = 256  # words; longer sentences pass one by one instead of in step with the others, with the same result


def form_features(form: str) -> list[str]:
    low = form.lower()
    out = ["w" + low]
    out += ["p" + low[:k] for k in range(2, 7) if len(low) > k]
    out += ["s" + low[-k:] for k in range(2, 5) if len(low) > k]
    if low != form:
        out.append("upper" if form.isupper() else "title")
    if any(ch.isdigit() for ch in form):
        out.append("digit")
    return out


def _buckets(form: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in form_features(form)]


def chains(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of every chain, longest first."""
    begin = np.flatnonzero(opens)
    size = np.diff(np.append(begin, len(opens)))
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order]


def forward_backward(e: np.ndarray, opens: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Log potentials of both labels from either side: alpha and beta (n, 2). Chains
    move together, one position at a time, but for the long ones, of which there
    are too few for array operations; ``e`` is the score of label 1."""
    n = len(e)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    if not n:
        return alpha, beta
    begin, size = chains(opens)
    long = int(np.searchsorted(-size, -LONG_CHAIN, side="left"))
    for b, k in zip(begin[:long].tolist(), size[:long].tolist()):
        alpha[b:b + k], beta[b:b + k] = _one_chain(e[b:b + k].tolist(), trans.tolist(), start.tolist())
    begin, size = begin[long:], size[long:]
    if not len(size):
        return alpha, beta
    steps = np.searchsorted(-size, -np.arange(size[0]), side="left")  # chains longer than t
    alpha[begin] = start
    alpha[begin, 1] += e[begin]
    for t in range(1, size[0]):
        at = begin[:steps[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[at, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + e[at]
    for t in range(size[0] - 2, -1, -1):
        at = begin[:steps[t + 1]] + t
        b = beta[at + 1]
        b1 = b[:, 1] + e[at + 1]
        beta[at, 0] = np.logaddexp(b[:, 0] + trans[0, 0], b1 + trans[0, 1])
        beta[at, 1] = np.logaddexp(b[:, 0] + trans[1, 0], b1 + trans[1, 1])
    return alpha, beta


def _log_add(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def _one_chain(e: list[float], trans: list[list[float]], start: list[float]) -> tuple[np.ndarray, np.ndarray]:
    (t00, t01), (t10, t11) = trans
    a0, a1 = start[0], start[1] + e[0]
    alpha = [(a0, a1)]
    for x in e[1:]:
        a0, a1 = _log_add(a0 + t00, a1 + t10), _log_add(a0 + t01, a1 + t11) + x
        alpha.append((a0, a1))
    b0 = b1 = 0.0
    beta = [(b0, b1)]
    for x in e[:0:-1]:
        y = b1 + x
        b0, b1 = _log_add(b0 + t00, y + t01), _log_add(b0 + t10, y + t11)
        beta.append((b0, b1))
    return np.array(alpha), np.array(beta[::-1])


def marginals(e, opens, trans, start) -> np.ndarray:
    """P(label 1) at each position."""
    alpha, beta = forward_backward(e, opens, trans, start)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))


class Chain:
    """A fitted model: emission weights by bucket, transitions, document weights."""

    def __init__(self, weights, bias, trans, start, final):
        self.weights, self.bias, self.trans, self.start, self.final = weights, bias, trans, start, final

    def emissions(self, words: Words, cache: dict | None = None) -> np.ndarray:
        cache = {} if cache is None else cache
        if len(cache) > CACHE_FORMS:
            cache.clear()
        scores = np.empty(len(words.forms))
        for k in np.unique(words.code).tolist():
            form = words.forms[k]
            got = cache.get(form)
            if got is None:
                got = cache[form] = float(self.weights[_buckets(form)].sum()) + self.bias
            scores[k] = got
        return scores[words.code]

    def tag(self, words: Words, cache: dict | None = None) -> np.ndarray:
        return marginals(self.emissions(words, cache), words.opens, self.trans, self.start)

    def document_scores(self, words: Words, p: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(words, p, rows) @ self.final, -30, 30)))


def document_features(words: Words, p: np.ndarray, rows: int) -> np.ndarray:
    """Per text: 1, the largest marginal, and of the tokens at SPAN_LEVEL or more the
    log of their summed marginals and the square root of their share."""
    total = np.bincount(words.row, np.where(p >= SPAN_LEVEL, p, 0), minlength=rows)
    count = np.bincount(words.row, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, words.row, p)
    return np.stack([np.ones(rows), most, np.log1p(total), np.sqrt(total / np.maximum(count, 1))], axis=1)


def token_labels(words: Words, labels: np.ndarray, min_share: float = MIN_SHARE, min_docs: int = 3,
                 min_lift: float = MIN_LIFT) -> np.ndarray:
    """Labels of the tokens from labels of their texts. A form, or a beginning of
    4 to 6 letters, is toxic if it is in ``min_share`` of the toxic texts
    (``min_docs`` at least) and ``min_lift`` times likelier there than elsewhere."""
    keys = [[f for f in form_features(form) if f[0] == "w" or (f[0] == "p" and len(f) >= 5)] for form in words.forms]
    names: dict[str, int] = {}
    ids = [[names.setdefault(f, len(names)) for f in fs] for fs in keys]
    pairs = np.unique(words.row * (len(words.forms) + 1) + words.code)
    row, code = np.divmod(pairs, len(words.forms) + 1)
    per = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter((f for fs in ids for f in fs), dtype=np.int64, count=int(per.sum()))
    first = np.cumsum(per) - per
    n = per[code]
    expanded = flat[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    pairs = np.unique(np.repeat(row, n) * len(names) + expanded)
    row, feature = np.divmod(pairs, len(names))
    toxic = np.bincount(feature, labels[row], minlength=len(names))
    clean = np.bincount(feature, 1 - labels[row], minlength=len(names))
    n_toxic, n_clean = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    lift = ((toxic + 0.5) / n_toxic) / ((clean + 0.5) / n_clean)
    seed = (toxic >= max(min_docs, min_share * n_toxic)) & (lift >= min_lift)
    marked = np.fromiter((any(seed[f] for f in fs) for fs in ids), dtype=bool, count=len(ids))
    return (marked[words.code] & (labels[words.row] == 1)).astype(float)


def fit_chain(words: Words, y: np.ndarray, rounds: int = 40, rate: float = 0.5, decay: float = 1e-6) -> Chain:
    """Maximum likelihood by Adam over all chains, which are whole sentences."""
    lists = [_buckets(f) for f in words.forms]
    per = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((b for bs in lists for b in bs), dtype=np.int64, count=int(per.sum()))
    owner = np.repeat(np.arange(len(lists)), per)
    theta = np.zeros(BUCKETS + 7)  # weights, bias, 2 x 2 transitions, 2 starts
    theta[BUCKETS] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(~words.opens)  # positions with one before them
    y_int, n = y.astype(int), max(len(y), 1)
    for turn in range(1, rounds + 1):
        trans, start = theta[BUCKETS + 1:BUCKETS + 5].reshape(2, 2), theta[BUCKETS + 5:]
        e = (np.bincount(owner, theta[flat], minlength=len(lists)) + theta[BUCKETS])[words.code]
        alpha, beta = forward_backward(e, words.opens, trans, start)
        both = alpha + beta
        log_z = np.logaddexp(both[:, 0], both[:, 1])
        off = y - np.exp(both[:, 1] - log_z)
        grad = np.zeros_like(theta)
        by_form = np.bincount(words.code, off, minlength=len(lists))
        grad[:BUCKETS] = np.bincount(flat, by_form[owner], minlength=BUCKETS)
        grad[BUCKETS] = off.sum()
        for i in range(2):
            for j in range(2):
                seen = ((y_int[inner - 1] == i) & (y_int[inner] == j)).sum()
                p = np.exp(alpha[inner - 1, i] + trans[i, j] + j * e[inner] + beta[inner, j] - log_z[inner])
                grad[BUCKETS + 1 + 2 * i + j] = seen - p.sum()
        firsts = np.flatnonzero(words.opens)
        for i in range(2):
            grad[BUCKETS + 5 + i] = (y_int[firsts] == i).sum() - np.exp(both[firsts, i] - log_z[firsts]).sum()
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.98 ** turn)) + 1e-9)
    return Chain(theta[:BUCKETS].astype(np.float32), float(theta[BUCKETS]),
                 theta[BUCKETS + 1:BUCKETS + 5].reshape(2, 2).copy(), theta[BUCKETS + 5:].copy(), None)


def _unlike(texts: list[str], hashes: int = 3) -> list[int]:
    """Places of the texts that share no smallest five-word shingle hash (of
    ``hashes`` orders) with an earlier one: copies would pass for evidence."""
    seen: list[set[int]] = [set() for _ in range(hashes)]
    keep = []
    for i, text in enumerate(texts):
        parts = text.lower().split()
        h = np.array([zlib.crc32(" ".join(parts[k:k + 5]).encode("utf-8", "surrogatepass"))
                      for k in range(max(len(parts) - 4, 1))], dtype=np.uint64)
        low = [int((h * np.uint64(2 * k + 0x9E3779B1) % np.uint64(0xFFFFFFFB)).min()) for k in range(hashes)]
        if not any(x in s for x, s in zip(low, seen)):
            keep.append(i)
        for x, s in zip(low, seen):
            s.add(x)
    return keep


def fit(texts: list[str], labels: np.ndarray, min_share: float = MIN_SHARE, min_lift: float = MIN_LIFT) -> Chain:
    """The chain from all rows of the sample; the document weights from the odd rows
    as a chain of the even ones tags them. Rows come in hash order; of equal and near-equal texts the first counts."""
    keep = _unlike(texts)
    texts, labels = [texts[i] for i in keep], labels[keep].astype(float)
    if labels.sum() == 0 or labels.sum() == len(labels):  # nothing to tell apart
        level = (labels.sum() + 1) / (len(labels) + 2)
        return Chain(np.zeros(BUCKETS, np.float32), -30.0, np.zeros((2, 2)), np.zeros(2),
                     np.array([np.log(level / (1 - level)), 0, 0, 0]))
    words = scan(texts)
    token = token_labels(words, labels, min_share, min_lift=min_lift)
    side = np.zeros(len(labels), dtype=int)
    for value in (0, 1):  # alternate inside each class
        of = np.flatnonzero(labels == value)
        side[of] = np.arange(len(of)) % 2
    mine = side[words.row] == 0
    half = replace(words, **{k: getattr(words, k)[mine] for k in ("row", "start", "end", "opens", "code")})
    x = document_features(words, fit_chain(half, token[mine]).tag(words), len(texts))
    use = side == 1 if len(set(labels[side == 1])) == 2 else side >= 0
    chain = fit_chain(words, token)
    chain.final = logistic(x[use], labels[use])
    return chain


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [1.0] * (x.shape[1] - 1)) * ridge * len(y) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - keep @ w
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, grad)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_PER_CLASS,
          min_share: float = MIN_SHARE, min_lift: float = MIN_LIFT) -> Chain:
    """Fit on at most ``max_per_class`` labelled rows of each class, in one task.
    ``min_share`` and ``min_lift`` bound which words of toxic texts are labelled (``token_labels``)."""

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts).sort_values("place") if parts else pd.DataFrame({"text": [], "label": []})
        model = fit(rows["text"].fillna("").tolist(), rows["label"].to_numpy(dtype=float), min_share, min_lift)
        yield pd.DataFrame({"model": [pickle.dumps([model.weights, model.bias, model.trans, model.start, model.final])]})

    rows = labelled_sample(docs, labels, label, max_per_class).repartition(1).mapInPandas(fitted, "model binary").collect()
    return Chain(*pickle.loads(rows[0].model)) if rows else fit([], np.zeros(0))


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` (any columns, one named text) plus ``tox``: a struct of ``score``
    (0 to 1) and ``spans`` of toxic words (start, end in code points, end
    exclusive; neighbouring words of a sentence are one span). Null and empty
    texts get the score of a text without toxic words. Whole texts are tagged;
    equal texts get equal scores; repeated rows stay."""

    def scored(texts: pd.Series) -> pd.DataFrame:
        cache, out = worker_cache("toxic forms").setdefault(mark, {}), []
        texts = texts.fillna("")
        for a, b in slices(texts):
            some = texts.iloc[a:b].tolist()
            words = scan(some)
            p = model.tag(words, cache)
            spans: list[list] = [[] for _ in some]
            before = -2
            for k in np.flatnonzero(p >= SPAN_LEVEL).tolist():
                mine = spans[words.row[k]]
                if before == k - 1 and not words.opens[k]:
                    mine[-1]["end"] = int(words.end[k])
                else:
                    mine.append({"start": int(words.start[k]), "end": int(words.end[k])})
                before = k
            out.append(pd.DataFrame({"score": model.document_scores(words, p, len(some)), "spans": spans}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"score": [], "spans": []})

    mark = zlib.crc32(model.weights.tobytes())
    return docs.withColumn("tox", pandas_udf(scored, "score double, spans array<struct<start:int,end:int>>")(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, level: float = 0.7, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """``docs`` without the documents whose score reaches ``level``; columns are
    unchanged. The model learns from the labelled rows among them."""
    model = train(docs, labels, max_per_class=max_per_class)
    keep = score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return keep.where(F.col("tox.score") < level).select("row.*")
