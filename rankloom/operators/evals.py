"""Evaluation metrics over scoring runs.

Every metric is a grouped aggregate over (case, listing, score) rows, so a run
over any number of cases is one shuffle on the case key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ["strong", "mid", "weak", "extra_weak"]
STRONG_MIN, WEAK_MAX, GAP_MIN, SPAN_MIN = 60, 40, 20, 30
PASS_SHARE = 0.8  # 4 of 5 trials
BAND = (-5, 3)


def _keys(case) -> list[str]:
    return [case] if isinstance(case, str) else list(case)


def score_quality(ev: DataFrame, case) -> DataFrame:
    """D12 over labelled listings (``role`` of ROLES, ``score``): strong >= 60,
    weak <= 40, gap >= 20, strong > mid, span of strong, mid and weak >= 30,
    share of scores that are not multiples of 5. The roles are the labels' own,
    so every check can fail."""
    def at(role):
        return F.max(F.when(F.col("role") == role, F.col("score")))
    main = F.when(F.col("role") != ROLES[-1], F.col("score"))
    g = ev.groupBy(*_keys(case)).agg(
        *[at(r).alias(r) for r in ROLES], (F.max(main) - F.min(main)).alias("span"),
        F.round(F.avg(F.when(F.col("score") % 5 != 0, 1.0).otherwise(0.0)), 4).alias("non_round_share"))
    return g.select(
        *_keys(case), *ROLES, "span", "non_round_share",
        F.coalesce(F.col("strong") >= STRONG_MIN, F.lit(False)).alias("strong_ok"),
        F.coalesce(F.col("weak") <= WEAK_MAX, F.lit(False)).alias("weak_ok"),
        F.coalesce((F.col("strong") - F.col("weak")) >= GAP_MIN, F.lit(False)).alias("gap_ok"),
        F.coalesce(F.col("strong") > F.col("mid"), F.lit(False)).alias("order_ok"),
        F.coalesce(F.col("span") >= SPAN_MIN, F.lit(False)).alias("span_ok"))


def labelled_ranks(ev: DataFrame, case, item: str) -> DataFrame:
    """E7 over labelled listings: is strong in the top 2 and weak in the bottom 2
    of its case? A group is one case's handful of labelled listings."""
    w = Window.partitionBy(*_keys(case)).orderBy(F.col("score").desc(), F.col(item))
    g = ev.withColumn("rank", F.row_number().over(w).cast("bigint")).groupBy(*_keys(case)).agg(
        F.count("*").alias("n_candidates"), F.max(F.when(F.col("role") == "strong", F.col("rank"))).alias("strong_rank"),
        F.max(F.when(F.col("role") == "weak", F.col("rank"))).alias("weak_rank"))
    return g.select("*", F.coalesce(F.col("strong_rank") <= 2, F.lit(False)).alias("strong_in_top2"),
                    F.coalesce(F.col("weak_rank") > F.col("n_candidates") - 2, F.lit(False)).alias("weak_in_bottom2"))


def rank_position(scores: DataFrame, case, item: str, gold) -> DataFrame:
    """Rank of the best gold listing in each case's ranking (score desc,
    then item); in the top 2?

    The rank is ``1 + #rows ordered before the best gold row``: a grouped
    minimum and a grouped conditional count (both partial aggregates), so a
    case with millions of candidates never sorts in one task.
    """
    key = F.struct((-F.col("score")).alias("ns"), F.col(item).alias("it"))
    keys = _keys(case)
    best = scores.filter(gold).groupBy(*keys).agg(F.min(key).alias("_best"))
    x = scores.join(best, keys, "left").withColumn("_k", key)
    g = x.groupBy(*keys).agg(F.count("*").alias("n_candidates"),
                            F.first("_best", ignorenulls=True).alias("_best"),
                            F.count_if(F.col("_k") < F.col("_best")).alias("_before"))
    rank = F.when(F.col("_best").isNotNull(), F.col("_before") + 1)
    return g.select(*keys, "n_candidates", rank.alias("gold_rank"),
                    F.coalesce(rank <= 2, F.lit(False)).alias("gold_in_top2"))


def pass_rate(trials: DataFrame, keys: list[str], share: float = PASS_SHARE) -> DataFrame:
    """Passes / trials per (case, check); pass when at least ``share`` of
    the trials do (0.6: 3 of 5; 0.8: 4 of 5; 1.0: all)."""
    g = trials.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_if("passed").alias("passes"))
    return g.withColumn("rate", F.round(F.col("passes") / F.col("n_trials"), 4)) \
        .withColumn("passed", F.col("passes") >= F.ceil(F.col("n_trials") * F.lit(share)))


def feedback_effect(runs: DataFrame, key: str) -> DataFrame:
    """Score with minus without feedback weights, per profile: mean change,
    changed count, share inside the tolerance band (-5, +3)."""
    d = F.col("with_feedback") - F.col("without_feedback")
    g = runs.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg(d), 4).alias("mean_change"),
        F.count_if(d != 0).alias("n_changed"),
        F.round(F.avg(F.when((d >= BAND[0]) & (d <= BAND[1]), 1.0).otherwise(0.0)), 4).alias("in_band_share"))
    return g


def feedback_gap(runs: DataFrame, key: str) -> DataFrame:
    """What feedback does to liked and to disliked listings that it was not
    learnt from (``user_rating`` 1 or -1, ``without_feedback``, ``with_feedback``).
    Liked ones may lose 5 points on average at most, disliked ones gain 3, and the
    gap between the two may narrow by 5. Without one of the classes its change is
    null and passes; without either the gap is null and passes."""
    def mean(rating, column):
        return F.avg(F.when(F.col("user_rating") == rating, F.col(column)))
    g = runs.groupBy(key).agg(
        F.count_if(F.col("user_rating") == 1).alias("n_liked"), F.count_if(F.col("user_rating") == -1).alias("n_disliked"),
        *[mean(r, f"{w}_feedback").alias(f"_{name}_{w}") for r, name in ((1, "liked"), (-1, "disliked")) for w in ("with", "without")])
    liked, disliked = F.col("_liked_with") - F.col("_liked_without"), F.col("_disliked_with") - F.col("_disliked_without")
    before, after = F.col("_liked_without") - F.col("_disliked_without"), F.col("_liked_with") - F.col("_disliked_with")
    passes = lambda c: F.coalesce(c, F.lit(True))
    return g.select(
        key, "n_liked", "n_disliked", F.round(liked, 4).alias("liked_change"), F.round(disliked, 4).alias("disliked_change"),
        F.round(before, 4).alias("gap_without"), F.round(after, 4).alias("gap_with"), F.round(after - before, 4).alias("gap_change"),
        passes(liked >= BAND[0]).alias("liked_ok"), passes(disliked <= BAND[1]).alias("disliked_ok"),
        passes(after - before >= BAND[0]).alias("gap_ok"))
