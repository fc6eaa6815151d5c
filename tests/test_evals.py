"""Relevance scorer on a four-role eval set (strong / mid / weak / extra weak),
scored with the same metrics as the eval queries (D12, E7)."""

from pyspark.sql import functions as F

from rankloom.operators import evals as EV
from rankloom.operators import relevance as R

RESUME = ("pipeline engineer building spark streaming jobs, parquet lakes, shuffle tuning, "
          "skew handling and window aggregations for billing analytics")
LISTINGS = [
    (1, "strong", "spark streaming engineer: parquet lake, shuffle tuning, skew handling, window aggregations"),
    (2, "mid", "analytics engineer for billing dashboards with some spark and parquet"),
    (3, "weak", "front desk coordinator for a dental clinic, scheduling and billing"),
    (4, "extra_weak", "line cook for a busy seafood kitchen"),
]
# filler documents so that document frequencies mean something
FILLER = [(100 + i, "filler", f"general office work number {i} with phone calls and filing") for i in range(40)]


def test_scorer_orders_roles(spark):
    docs = spark.createDataFrame(LISTINGS + FILLER, "doc_id long, role string, text string")
    queries = spark.createDataFrame([(1, RESUME)], "item_id long, text string")
    rel = R.relevance(spark, queries, "item_id", "text", docs, "doc_id", "text", min_score=0)
    scores = {r.doc_id: r.score for r in rel.collect()}
    assert scores[1] > scores.get(2, 0) > scores.get(3, 0) >= scores.get(4, 0)
    pairs = docs.filter("doc_id < 100").select(F.lit(1).alias("item_id"), "doc_id", "role", F.lit(RESUME).alias("q"), "text")
    same = R.pair_relevance(spark, pairs, ["item_id", "doc_id"], "q", "text", docs, "doc_id", "text")
    assert {r.doc_id: r.score for r in same.collect()} == {k: scores.get(k, 0) for k in range(1, 5)}
    ev = pairs.join(same, ["item_id", "doc_id"])
    q = EV.score_quality(ev, "item_id").first()
    assert q.order_ok and q.weak_ok and q.gap_ok
    rank = EV.labelled_ranks(ev, "item_id", "doc_id").first()
    assert rank.strong_in_top2 and rank.weak_in_bottom2
    assert EV.rank_position(rel, "item_id", "doc_id", F.col("doc_id") == 1).first().gold_rank == 1


def test_wrong_order_fails_the_labelled_checks(spark):
    ev = spark.createDataFrame([(1, 1, "strong", 10), (1, 2, "mid", 50), (1, 3, "weak", 90), (1, 4, "extra_weak", 60)],
                               "c long, d long, role string, score int")
    q, r = EV.score_quality(ev, "c").first(), EV.labelled_ranks(ev, "c", "d").first()
    assert not (q.strong_ok or q.weak_ok or q.gap_ok or q.order_ok or r.strong_in_top2 or r.weak_in_bottom2)


def test_pass_rate_threshold(spark):
    trials = spark.createDataFrame([("c", "strong", i, i < 4) for i in range(5)] +
                                   [("c", "gap", i, i < 3) for i in range(5)],
                                   "case string, check string, trial int, passed boolean")
    got = {r.check: (r.passes, r.passed) for r in EV.pass_rate(trials, ["case", "check"]).collect()}
    assert got == {"strong": (4, True), "gap": (3, False)}
    easier = {r.check: r.passed for r in EV.pass_rate(trials, ["case", "check"], 0.6).collect()}
    stricter = {r.check: r.passed for r in EV.pass_rate(trials, ["case", "check"], 1.0).collect()}
    assert easier == {"strong": True, "gap": True} and stricter == {"strong": False, "gap": False}


def test_feedback_gap_by_hand(spark):
    from rankloom.operators import evals as EV
    rows = [(1, 1, 50.0, 60.0), (1, 1, 40.0, 40.0), (1, -1, 30.0, 20.0),  # gap 15 -> 30
            (2, 1, 50.0, 40.0), (2, -1, 30.0, 40.0),  # gap 20 -> 0
            (3, 1, 10.0, 5.0), (4, -1, 10.0, 13.0)]  # on the bands; one class only
    x = spark.createDataFrame(rows, "profile_id long, user_rating int, without_feedback double, with_feedback double")
    got = {r.profile_id: tuple(r)[1:] for r in EV.feedback_gap(x, "profile_id").collect()}
    assert got == {1: (2, 1, 5.0, -10.0, 15.0, 30.0, 15.0, True, True, True),
                   2: (1, 1, -10.0, 10.0, 20.0, 0.0, -20.0, False, False, False),
                   3: (1, 0, -5.0, None, None, None, None, True, True, True),
                   4: (0, 1, None, 3.0, None, None, None, True, True, True)}
