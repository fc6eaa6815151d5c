"""Shared keyword search and suggestions from resumes, against brute force."""

import random

from pyspark.sql import functions as F

from rankloom.operators import keywords as KW
from rankloom.operators import resume as RS

KIND = "array<struct<keyword:string,weight:double>>"


def test_keyword_hits_equal_brute_force(spark):
    rng = random.Random(6)
    letters = "abcAB é!*."
    texts = [(k, "".join(rng.choices(letters, k=rng.randint(0, 40)))) for k in range(150)] + [(200, None), (201, ""), (202, "a" * 50_000)]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(80)] + ["a", "!!", "***", "", None, "zzz", "AB", "ab"]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.keyword) for r in KW.keyword_hits(docs, "id", "text", spark.createDataFrame([(w,) for w in words], "keyword string")).collect()}
    want = {(k, w.lower()) for k, t in texts for w in words if w and t and w.lower() in t.lower()}
    assert got == want and {len(w) for _, w in want} >= {1, 2, 3, 4}
    assert KW.keyword_hits(docs.limit(0), "id", "text", spark.createDataFrame([("a",)], "keyword string")).count() == 0
    assert KW.keyword_hits(docs, "id", "text", spark.createDataFrame([(None,)], "keyword string")).count() == 0


def test_shared_deltas_by_class(spark):
    docs = spark.createDataFrame([(1, "Gear and bolt"), (2, "plate gearbox"), (3, "nothing")], "id long, text string")
    rows = [(7, [("gear", 16.0), ("GEAR", 3.0)], [("plate", -25.0)]), (5, [("gear", 16.0), ("GEAR", 3.0)], [("plate", -25.0)]),
            (6, [("bolt", 50.0)], None), (8, None, None), (9, [("", 9.0)], [])]
    who = spark.createDataFrame(rows, f"profile_id long, boost {KIND}, penalize {KIND}")
    assert {(r.class_id, r.profile_id) for r in KW.keyword_classes(who).collect()} == {(5, 5), (5, 7), (6, 6), (8, 8), (9, 9)}
    got = {(r.class_id, r.id): (r.n_hits, r.delta) for r in KW.shared_deltas(docs, "id", "text", who).collect()}
    assert got == {(5, 1): (2, 19.0), (5, 2): (3, -6.0), (6, 1): (1, 20.0)}


def test_resume_suggestions_keep_their_bounds(spark):
    rng = random.Random(8)
    common = [f"common{chr(97 + k)}" for k in range(26)]
    rare = ["".join(rng.choices("ghijklmn", k=6)) for _ in range(200)]
    docs = [(k, " ".join(rng.choices(common, k=25) + rng.choices(rare, k=10))) for k in range(200)]
    own = " ".join(rng.sample(rare, 30))
    docs += [(900, own), (901, own + " machine learning")]
    resumes = spark.createDataFrame([(1, f"Machine Learning {own} commona"), (2, ""), (3, "ok go")], "item_id long, text string")
    got = RS.suggest_from_resumes(spark, resumes, "item_id", "text", spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    mine = {kind: sorted((r for r in got if r.item_id == 1 and r.kind == kind), key=lambda r: r.rank) for kind in ("title", "boost", "penalize")}
    assert 8 <= len(mine["title"]) <= 12 and 15 <= len(mine["boost"]) <= 20 and 5 <= len(mine["penalize"]) <= 10
    assert "Machine Learning" in {r.keyword for r in mine["title"]}
    assert all(1 <= r.weight <= 20 for r in mine["boost"]) and all(-50 <= r.weight <= -10 for r in mine["penalize"])
    assert not {r.keyword for r in mine["penalize"]} & set(own.split() + ["commona"])
    assert {r.kind for r in got if r.item_id == 2} == {"penalize"}


def test_phrases(spark):
    row = spark.sql("select 'A big, red fox of  old big red' as t").select(RS.phrases(F.col("t")).alias("p")).first()
    assert row.p == ["big red", "red fox", "old big", "big red"]


def test_phrase_holders_are_counted_once_per_row(spark):
    texts = ["red fox red fox red", "Red, fox", None, "", "red", "big red of fox", "red fox", "fox\nred"]
    docs = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "id long, text string")
    sought = spark.createDataFrame([("red fox",), ("fox red",), ("not there",), ("of fox",)], "phrase string")
    got = {r.phrase: r.both for r in RS._holders(docs, "text", sought).collect()}
    held = docs.select(F.explode(F.array_distinct(RS.phrases(F.col("text")))).alias("phrase")).join(sought, "phrase", "left_semi")
    assert got == {r.phrase: r["count"] for r in held.groupBy("phrase").count().collect()} == {"red fox": 3, "fox red": 2}


def test_resume_set_up_splits_only_the_best_listings(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{chr(97 + k % 26)} common thing") for k in range(60)], "doc_id long, text string")
    resumes = spark.createDataFrame([(1, "wordx common"), (2, "wordy thing")], "item_id long, text string")
    frames, real = {}, RS.materialize
    monkeypatch.setattr(RS, "materialize", lambda df, name: frames.setdefault(name, real(df, name)))
    RS.suggest_from_resumes(spark, resumes, "item_id", "text", docs, "doc_id", "text").collect()
    assert 2 <= frames["best-listings"].count() <= 2 * RS.BEST_LISTINGS
    assert frames["common-words"].count() <= frames["corpus-words"].count()
