"""Term relevance: the K best and the threshold join against brute force; the language model."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from conftest import SMALL
from rankloom.operators import language as LG
from rankloom.operators import relevance as R


def corpus(seed, n_docs=300, n_queries=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    share = [1 / (k + 1) for k in range(400)]  # a few words are everywhere
    docs = [(k, " ".join(rng.choices(words, share, k=rng.randint(0, 60)))) for k in range(n_docs)]
    queries = [(k, " ".join(rng.choices(words, share, k=rng.randint(0, 25)))) for k in range(n_queries)]
    return docs + [(n_docs, ""), (n_docs + 1, docs[3][1])], queries + [(90, "zzzz"), (91, ""), (92, words[0])]


def brute(docs, queries, evidence=False):
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    held = {d: set(split(t)) for d, t in docs}
    df = Counter(w for ws in held.values() for w in ws)
    weight = {w: math.floor(100 * math.log(len(docs) / n) + 0.5) for w, n in df.items()}
    for q, text in queries:
        tf = Counter(split(text))
        own = {t: weight[t] * (n if evidence else 1) for t, n in tf.items() if t in weight}
        for d, ws in held.items():
            hits = [t for t in own if t in ws]
            yield q, d, len(hits), sum(own[t] for t in hits), sum(own.values())


def frames(spark, docs, queries):
    return (spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(docs, "d long, t string"))


def test_top_equals_brute_force(spark):
    for seed, k in ((1, 3), (2, 7), (3, 1)):
        docs, queries = corpus(seed)
        qs, ds = frames(spark, docs, queries)
        got = {(r.q, r.pos): (r.d, r.matched, r.total) for r in R.relevance_top(spark, qs, "q", "t", ds, "d", "t", k).collect()}
        want = {}
        for q in {q for q, _ in queries}:
            best = sorted(((-m, d, t) for qq, d, _, m, t in brute(docs, queries) if qq == q and m > 0))[:k]
            want |= {(q, i): (d, -m, t) for i, (m, d, t) in enumerate(best, 1)}
        assert got == want and len(want) > 10 * k


def test_threshold_join_equals_brute_force(spark):
    docs, queries = corpus(4)
    qs, ds = frames(spark, docs, queries)
    for evidence in (False, True):
        for bar in (1, 20, 55):
            got = {(r.q, r.d, r.n_terms, r.matched, r.total)
                   for r in R.relevance(spark, qs, "q", "t", ds, "d", "t", evidence, bar).collect()}
            want = {x for x in brute(docs, queries, evidence) if x[4] > 0 and 100 * x[3] // x[4] >= bar}
            assert got == want and want


def test_top_forms_few_pairs(spark):
    """On the landed tables the candidate join makes a small share of all pairs."""
    sf = SMALL.replace("0.001", "0.1")
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    qw, arrays = R._weighted(spark, items, "item_id", "text", docs, "doc_id", "text", ("plain",))
    made = R.candidates(R.with_top_bars(qw, arrays, 5), arrays, ("plain",)).count()
    seeds = R.candidates(qw.withColumn("bar_plain", F.expr(f"({R.SEED_SHARE} * total_plain + 99) div 100")), arrays, ("plain",)).count()
    every = docs.count() * items.count()
    print(f"{seeds} + {made} of {every} pairs")
    assert 0 < made + seeds < 0.06 * every and made < 0.05 * every


def test_bar_matches_few_pairs_exactly(spark, monkeypatch):
    docs, queries = corpus(5)
    qs, ds = frames(spark, docs, queries)
    made, real = [], R._exact
    monkeypatch.setattr(R, "_exact", lambda *a: made.append(real(*a)) or made[-1])
    R.relevance_top(spark, qs, "q", "t", ds, "d", "t", 2)
    assert 2 <= made[0].groupBy("q").count().agg(F.max("count")).first()[0] <= 2 * R.SEED_DOCS


def test_language_look_up_is_by_number_and_exact(spark, monkeypatch):
    base = {"xx": "kala mika tuno rela", "yy": "strub grolf drent klopf"}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(base[lang].split(), k=6)), lang) for k in range(30) for lang in [("xx", "yy")[k % 2]]]
    docs = spark.createDataFrame(rows + [(100, "zzzz qqqq", None), (101, "kala", None), (101, "strub grolf", None)], "id long, text string, lang string")
    written, real = [], LG.materialize
    monkeypatch.setattr(LG, "materialize", lambda df, name: written.append(name) or real(df, name))
    model = LG.learn(docs, "id", "text", "lang", per_language=10)
    assert "language-sample" in written
    found = LG.detect(docs, "id", "text", model)
    assert "xxhash64(gram" in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, found.collect()))
    assert 100 not in dict(want) and len(want) == 31
    # every gram gets the same number: all hits but the right ones are then of other grams
    monkeypatch.setattr(LG.F, "xxhash64", lambda c: F.length(c).cast("bigint") * 0)
    assert sorted(map(tuple, LG.detect(docs, "id", "text", model).collect())) == want


def test_language_model(spark):
    base = {"xx": "kala mika tuno rela", "yy": "strub grolf drent klopf"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(base[lang].split(), k=20)), lang) for k in range(60) for lang in [("xx", "yy")[k % 2]]]
    rows += [(100, "12 34 !!", "xx"), (101, None, "yy"), (102, "", None), (103, "kala", None), (104, "grolf " * 20_000, None),
             (105, "дом", None), (None, "kala", "xx")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    model = LG.learn(docs, "id", "text", "lang", per_language=10)
    assert model.languages == ["xx", "yy"]
    got = {r.id: r.detected_language for r in LG.detect(docs.where("id is not null"), "id", "text", model).collect()}
    assert all(got[k] == lang for k, _, lang in rows[:60]) and got[103] == "xx" and got[104] == "yy"
    assert not {100, 101, 102, 105} & set(got)
    nothing = LG.learn(docs.withColumn("lang", F.lit(None).cast("string")), "id", "text", "lang")
    assert nothing.languages == [] and LG.detect(docs, "id", "text", nothing).count() == 0
