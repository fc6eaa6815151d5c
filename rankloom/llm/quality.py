"""Document quality by Bradley-Terry pairwise ranking.

A good and a bad labelled document form a preference pair; a linear score is
learned so that the good one wins: logistic loss on the difference of their
features. Features describe form, not topic: repetition, case, symbols, line
and word shapes, each also as steps at its quantiles. The cut is the quantile
of the scores below which the share of bad documents lies; scores are mapped so
that the cut falls on ``level``.

Every labelled row is learnt from, by jobs that pass over the rows: means,
spreads and class sizes; exact quantiles digit by digit; Newton steps, each the
sum of its tasks' gradients and curvatures over pairs in which every row stands;
and the cut, an exact order statistic of all scores. A task holds one batch, or
one part of about ``PART_ROWS`` rows when pairs are made.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankloom.llm.common import Scratch

PAIRS = 200_000  # at least; each row of the larger class is in one pair or more
PART_ROWS = 20_000  # labelled rows that are paired with one another
PART_LEAST = 200  # rows of the smaller class in a part; where it has fewer, they stand in several parts
NEWTON_STEPS = 30
STEPS = 8  # quantile steps per feature
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
_COUNTED = {"upper": re.compile(r"[A-ZÀ-ÖØ-Þ]"), "digit": re.compile(r"\d"), "exclaim": re.compile(r"!"),
            "comma": re.compile(r"[,;:]"), "stop": re.compile(r"[.?]"), "pipe": re.compile(r"[|/\\<>{}\[\]=_~^]")}


def features(text: str) -> list[float]:
    """Numbers that describe the form of a whole text; the empty text has them too."""
    words, chars = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    top = counts.most_common(1)[0][1] if counts else 0
    beside = sum(map(str.__eq__, words, words[1:]))
    ends = Counter(w[-1] for w in words)
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), float((lengths <= 2).mean()), float((lengths >= 15).mean()),
        len(counts) / n, np.log1p(len(counts)) / np.log1p(n), top / n, beside / n,
        len(pairs) / max(n - 1, 1), (max(pairs.values()) if pairs else 0) / n,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)), np.log1p(chars / max(len(lines), 1)),
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        *(len(p.findall(text)) / chars for p in _COUNTED.values()),
        len(_SYMBOL.findall(text)) / chars, sum(c for ch, c in ends.items() if not ch.isalnum()) / n,
        len(text) / n,
    ]


class Ranker:
    """Feature scaling, quantile steps, weights and the score of the cut."""

    def __init__(self, mean, spread, edges, weights, cut, level):
        self.mean, self.spread, self.edges, self.weights = mean, spread, edges, weights
        self.cut, self.level = cut, level

    def design(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((raw - self.mean) / self.spread, -5, 5)
        steps = (raw[:, :, None] > self.edges[None]).reshape(len(raw), -1)
        return np.concatenate([x, steps], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.score_features(np.array([features(t) for t in texts])) if texts else np.zeros(0)

    def score_features(self, raw: np.ndarray) -> np.ndarray:
        z = self.design(raw) @ self.weights - self.cut + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 300,
                  batch: int = 8192, rate: float = 0.05) -> np.ndarray:
    """Weights w that make sigmoid(w (good - bad)) large over random pairs (Adam)."""
    rng = np.random.default_rng(7)
    i, j = rng.integers(len(good), size=pairs), rng.integers(len(bad), size=pairs)
    w = np.zeros(good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, rounds + 1):
        some = rng.integers(pairs, size=batch)
        x = good[i[some]] - bad[j[some]]
        grad = x.T @ (1 / (1 + np.exp(np.clip(x @ w, -30, 30)))) / batch - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-9)
    return w


def undecided(width: int, share: float, level: float) -> Ranker:
    """Where there is nothing to tell apart every score is the share of good ones."""
    share = float(np.clip(share, 0.01, 0.99))
    return Ranker(np.zeros(width), np.ones(width), np.full((width, STEPS), np.inf),
                  np.zeros(width * (STEPS + 1)), np.log(level / (1 - level)) - np.log(share / (1 - share)), level)


def fit(texts: list[str], labels: np.ndarray, bad_share: float, level: float) -> Ranker:
    """The model of a few texts, in memory. ``bad_share`` is the share of label 0 among
    all labelled rows. Without both classes every score is the share of good ones."""
    raw = np.array([features(t) for t in texts]) if texts else np.zeros((0, len(features(""))))
    if not texts or len(set(labels.tolist())) < 2:
        return undecided(raw.shape[1], labels.mean() if len(labels) else 0.5, level)
    edges = np.quantile(raw, np.linspace(0, 1, STEPS + 2)[1:-1], axis=0).T
    model = Ranker(raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-9), edges, None, 0.0, level)
    x = model.design(raw)
    model.weights = bradley_terry(x[labels == 1], x[labels == 0])
    s = x @ model.weights
    # the sample's classes weigh as they do among all labelled rows
    weight = np.where(labels == 0, bad_share / max((labels == 0).sum(), 1), (1 - bad_share) / max((labels == 1).sum(), 1))
    order = np.argsort(s)
    k = min(int(np.searchsorted(np.cumsum(weight[order]), bad_share)), len(s) - 1)
    model.cut = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    return model


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _summed(rows: DataFrame, of_batch: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray | None:
    """The sum over all rows of what ``of_batch`` gives for a batch: one array a task, added up by Spark."""
    def total(parts):
        out = None
        for part in parts:
            out = part if out is None else out + part
        if out is not None:
            yield pd.DataFrame({"s": [out.tobytes()]})

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from total(of_batch(b).astype(float).ravel() for b in batches if len(b))

    def of_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from total(np.frombuffer(s) for b in batches for s in b["s"])

    got = rows.mapInPandas(of_task, "s binary").repartition(1).mapInPandas(of_all, "s binary").collect()
    return np.frombuffer(got[0].s) if got else None


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats ``x``."""
    bits = (x + 0.0).view(np.uint64)  # -0.0 is 0.0
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def order_values(rows: DataFrame, column: str, ranks: list[int], width: int) -> np.ndarray:
    """Per element of the array ``column`` the values of the given ranks (from 0) among
    all rows, exactly: one byte of them a pass, by counts of the rows that agree so far."""
    found = np.zeros((width, len(ranks)), np.uint64)
    left = np.tile(np.array(ranks, dtype=float), (width, 1))
    for shift in range(56, -1, -8):
        def counts(batch: pd.DataFrame, found=found, shift=shift) -> np.ndarray:
            u = _ordered(_matrix(batch[column]))
            out = np.zeros((width, len(ranks), 256))
            for j in range(width):
                digit = ((u[:, j] >> np.uint64(shift)) & np.uint64(255)).astype(np.int64)
                for prefix in set(found[j].tolist()):
                    same = digit if shift == 56 else digit[(u[:, j] >> np.uint64(shift + 8)) == np.uint64(prefix)]
                    out[j, found[j] == prefix] = np.bincount(same, minlength=256)
            return out

        upto = _summed(rows, counts).reshape(width, len(ranks), 256).cumsum(axis=2)
        digit = (upto <= left[:, :, None]).sum(axis=2)
        before = np.take_along_axis(np.concatenate([np.zeros_like(upto[:, :, :1]), upto], axis=2), digit[:, :, None], axis=2)
        left = left - before[:, :, 0]
        found = (found << np.uint64(8)) | digit.astype(np.uint64)
    bits = np.where(found >> np.uint64(63), found & np.uint64((1 << 63) - 1), ~found)
    return bits.view(float)


def quantiles(rows: DataFrame, column: str, at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Exact quantiles of each element among ``n`` rows, linear between neighbours."""
    place = at * (n - 1)
    low, high = np.floor(place).astype(int), np.ceil(place).astype(int)
    values = order_values(rows, column, [*low.tolist(), *high.tolist()], width)
    a, b = values[:, :len(at)], values[:, len(at):]
    return a + (b - a) * (place - low)


def preference_pairs(rows: DataFrame, n_good: int, n_bad: int, width: int) -> DataFrame:
    """``good, bad``: features of pairs. Rows (``place, y, raw``) are dealt into parts by
    their hash and paired at random inside each, so that every row is in a pair."""
    fewer, less, more = (0, n_bad, n_good) if n_bad <= n_good else (1, n_good, n_bad)
    parts = -(-(n_good + n_bad) // PART_ROWS)
    copies = min(parts, -(-PART_LEAST * parts // less))
    rounds = max(1, -(-PAIRS // more))
    turns = F.when(F.col("y") == fewer, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("turn", F.explode(turns)).select(
        F.pmod(F.col("place") + F.col("turn"), F.lit(parts)).alias("part"), "place", "y", "raw")

    def paired(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(key=part["raw"].map(tuple)).sort_values(["place", "key"])
        raw = _matrix(part["raw"])
        few, many = raw[part["y"] == fewer], raw[part["y"] != fewer]
        if not len(few) or not len(many):
            return pd.DataFrame({"good": [], "bad": []})
        rng = np.random.default_rng(7)
        size = max(len(many), len(few))
        a, b = [], []
        for _ in range(rounds):
            a.append(rng.permutation(len(few))[np.arange(size) % len(few)])
            b.append(rng.permutation(len(many))[np.arange(size) % len(many)])
        few, many = few[np.concatenate(a)], many[np.concatenate(b)]
        good, bad = (many, few) if fewer == 0 else (few, many)
        return pd.DataFrame({"good": list(good), "bad": list(bad)})

    return dealt.groupBy("part").applyInPandas(paired, "good array<double>, bad array<double>")


def learned_weights(pairs: DataFrame, model: Ranker, ridge: float = 1e-3) -> np.ndarray:
    """The weights of least ridge logistic loss over all pairs, by Newton steps that
    are halved where the loss would grow."""
    d = model.mean.size * (STEPS + 1)

    def at(w: np.ndarray):
        def sums(batch: pd.DataFrame) -> np.ndarray:
            x = model.design(_matrix(batch["good"])) - model.design(_matrix(batch["bad"]))
            z = x @ w
            p = 1 / (1 + np.exp(np.clip(z, -30, 30)))
            return np.concatenate([[len(x), np.logaddexp(0, -z).sum()], x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        s = _summed(pairs, sums)
        n = s[0]
        return (s[1] / n + ridge / 2 * (w @ w), s[2:2 + d] / n - ridge * w,
                s[2 + d:].reshape(d, d) / n + ridge * np.eye(d))

    w = np.zeros(d)
    loss, grad, curve = at(w)
    step = np.linalg.solve(curve, grad)
    for _ in range(NEWTON_STEPS):
        if grad @ step < 1e-10:
            break
        new = at(w + step)
        if new[0] > loss:
            step = step / 2
            continue
        w, (loss, grad, curve) = w + step, new
        step = np.linalg.solve(curve, grad)
    return np.round(w, 7)  # sums of parts in another order differ in their last bits only


def describe(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, one named text) plus ``quality_features``, which ``train``
    and ``score`` then take in place of the text."""
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts.fillna("").tolist()], dtype=object)

    return docs.withColumn("quality_features", pandas_udf(described, "array<double>")(F.col("text")))


def _described(docs: DataFrame) -> DataFrame:
    return docs if "quality_features" in docs.columns else describe(docs)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", level: float = 0.3) -> Ranker:
    """Fit on every document with a label 0 or 1 (both: 1). Rows without a label or
    id are left out; without both classes every score is the share of good ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    scratch, width = Scratch(docs.sparkSession, "quality"), len(features(""))
    rows = scratch.save(_described(docs.join(known, "doc_id")).select(
        F.xxhash64("doc_id", F.lit("pair")).alias("place"), F.col("y").cast("int").alias("y"),
        F.col("quality_features").alias("raw")), "rows")
    each: list[Column] = [f(F.get("raw", F.lit(j))) for f in (F.avg, F.stddev_pop) for j in range(width)]
    n, n_good, *moments = rows.agg(F.count("*"), F.count_if(F.col("y") == 1), *each).first()
    if n_good in (0, n):
        return undecided(width, n_good / n if n else 0.5, level)
    mean, spread = np.array([float(f"{m:.10g}") for m in moments]).reshape(2, width)
    edges = quantiles(rows, "raw", np.linspace(0, 1, STEPS + 2)[1:-1], n, width)
    model = Ranker(mean, np.maximum(spread, 1e-9), edges, None, 0.0, level)
    model.weights = learned_weights(scratch.save(preference_pairs(rows, n_good, n - n_good, width), "pairs"), model)

    def raw_scores(raw: pd.Series) -> pd.Series:
        return pd.Series(list((model.design(_matrix(raw)) @ model.weights)[:, None]) if len(raw) else [], dtype=object)

    scores = scratch.save(rows.select(pandas_udf(raw_scores, "array<double>")("raw").alias("s")), "scores")
    low, high = order_values(scores, "s", [n - n_good - 1, n - n_good], 1)[0]
    model.cut = float((low + high) / 2)
    for name in ("rows", "pairs", "scores"):
        scratch.drop(name)
    return model


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs`` (any columns, one named text) plus ``quality_score`` (0 to 1), which
    replaces a column of that name. Null and empty texts are scored as empty;
    equal texts get equal scores; repeated rows stay. Features that ``describe``
    has added are used and dropped."""

    def scored(raw: pd.Series) -> pd.Series:
        return pd.Series(model.score_features(_matrix(raw)) if len(raw) else np.zeros(0))

    x = _described(docs)
    return x.withColumn("quality_score", pandas_udf(scored, "double")(F.col("quality_features"))).drop("quality_features")
