"""Re-ranking: positional joins of reranker answers (C7, J7), minimum relevance
(B14), the fallback chain (F6), and the in-engine rerankers (J6): vector
cosine over ``embeddings`` and term relevance (J5) on the candidate cut.

Every reranker works on the per-profile candidate cut (E2, at most
``rerank_candidates`` rows per profile), so its inputs are bounded per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIORITY = {"A": 1, "B": 2, "score": 3}


def rerank_document(reason="reason") -> Column:
    """``title at company (location)`` then the description, or the score
    reason when there is no description (whole text; the reference cuts it)."""
    body = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col(reason), F.lit(""))
    return F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" at "), F.coalesce(F.col("employer"), F.lit("")),
                    F.lit(" ("), F.coalesce(F.col("location"), F.lit("")), F.lit(")\n"), body)


def rerank_line(reason="reason") -> Column:
    """``i. title at company (location): description`` for list rerankers."""
    body = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col(reason), F.lit(""))
    return F.concat(F.col("idx").cast("string"), F.lit(". "), F.coalesce(F.col("title"), F.lit("")), F.lit(" at "),
                    F.coalesce(F.col("employer"), F.lit("")), F.lit(" ("), F.coalesce(F.col("location"), F.lit("")),
                    F.lit("): "), body)


def candidate_index(cands: DataFrame, pos_col: str = "pos") -> DataFrame:
    """0-based list index of each candidate, as sent to a reranker."""
    return cands.withColumn("idx", (F.col(pos_col) - 1).cast("int"))


def positional_a(cands: DataFrame, answers: DataFrame, min_score=None) -> DataFrame:
    """C7 variant A: ``answers(profile_id, resp_pos, index, relevance_score)``.

    Output order = answer order; a missing relevance counts 0.0; rows below
    ``min_score`` drop (B14; default: the profile's own ``rerank_min_score``);
    a negative index counts from the end; duplicates stay; candidates the answer
    does not mention drop. An index that is null or beyond the list fails the
    whole answer of its profile, which then has no rows here; see ``usable_a``.
    """
    a = _resolved(cands, answers).join(usable_a(cands, answers), "profile_id", "left_semi")
    return (a.join(cands, ["profile_id", "idx"])
            .withColumn("relevance", F.coalesce(F.col("relevance_score"), F.lit(0.0)))
            .filter(F.col("relevance") >= _bar(min_score))
            .select("profile_id", F.col("resp_pos").alias("order_key"), "relevance",
                    *[c for c in cands.columns if c not in ("profile_id",)]))


def _bar(min_score) -> Column:
    return F.col("rerank_min_score") if min_score is None else F.lit(min_score)


def _resolved(cands: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with ``idx``: the 0-based list index, null if there is no such row."""
    n = cands.groupBy("profile_id").agg(F.count("*").alias("_n"))
    at = F.when(F.col("index") < 0, F.col("index") + F.col("_n")).otherwise(F.col("index"))
    return answers.join(n, "profile_id").withColumn(
        "idx", F.when((at >= 0) & (at < F.col("_n")), at).cast("int"))


def usable_a(cands: DataFrame, answers: DataFrame) -> DataFrame:
    """``profile_id`` of the profiles whose whole answer A points at candidates."""
    return (_resolved(cands, answers).groupBy("profile_id")
            .agg(F.bool_and(F.col("idx").isNotNull()).alias("ok")).filter("ok").select("profile_id"))


def positional_b(cands: DataFrame, answers: DataFrame, min_score=None) -> DataFrame:
    """C7 variant B: ``answers(profile_id, ranked ARRAY<INT>, scores ARRAY<DOUBLE>)``.

    Entries that are not an in-range index are skipped; a missing score counts
    1.0; rows below ``min_score`` drop (default: the profile's own
    ``rerank_min_score``); answer order is kept.
    """
    z = answers.select("profile_id", F.posexplode(F.arrays_zip("ranked", "scores")).alias("resp_pos", "e"))
    z = z.select("profile_id", "resp_pos", F.col("e.ranked").alias("idx"),
                 F.coalesce(F.col("e.scores"), F.lit(1.0)).alias("relevance"))
    return (z.join(cands, ["profile_id", "idx"]).filter(F.col("relevance") >= _bar(min_score))
            .select("profile_id", F.col("resp_pos").alias("order_key"), "relevance",
                    *[c for c in cands.columns if c not in ("profile_id",)]))


def fallback(score_rows: DataFrame, a_rows: DataFrame, a_answered: DataFrame, b_rows: DataFrame) -> DataFrame:
    """A if reranker A gave a usable answer (``a_answered``; even an empty one,
    or one with nothing kept), else B if it kept anything, else score order. Chosen per profile by ``min(priority)`` over
    small per-profile markers, then joined back: no window over the rows."""
    cols = ["profile_id", "order_key", "job_url"]
    rows = (a_rows.select(*cols, F.lit(PRIORITY["A"]).alias("priority"))
            .unionByName(b_rows.select(*cols, F.lit(PRIORITY["B"]).alias("priority")))
            .unionByName(score_rows.select(*cols, F.lit(PRIORITY["score"]).alias("priority"))))
    markers = (a_answered.select("profile_id", F.lit(PRIORITY["A"]).alias("priority"))
               .unionByName(b_rows.select("profile_id", F.lit(PRIORITY["B"]).alias("priority")))
               .unionByName(score_rows.select("profile_id", F.lit(PRIORITY["score"]).alias("priority"))))
    chosen = markers.groupBy("profile_id").agg(F.min("priority").alias("priority"))
    src = F.element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(v), F.lit(k))]),
                       F.col("priority"))
    return rows.join(chosen, ["profile_id", "priority"]).withColumn("source", src)


def cosine_to_centroid(cands: DataFrame, key: str, vec: str, liked: DataFrame, group: str = "profile_id") -> DataFrame:
    """Cosine of each candidate's vector to its group's mean liked vector.

    Both sides are exploded to (group, dimension) rows and equi-joined on
    ``(group, dimension)``; dot product and norms are sums per candidate. No
    vector is ever shipped whole to another row, so there is no nested-loop
    join even when the group key is a constant.
    """
    cent = (liked.select(group, F.posexplode(vec).alias("i", "x"))
            .groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("c")))
    cv = cands.select(group, key, F.posexplode(vec).alias("i", "x"))
    j = cv.join(cent, [group, "i"], "left").select(group, key, F.col("x").cast("double").alias("x"), "c")
    g = j.groupBy(group, key).agg(F.sum(F.col("x") * F.col("c")).alias("dot"),
                                  F.sum(F.col("x") * F.col("x")).alias("xx"),
                                  F.sum(F.col("c") * F.col("c")).alias("cc"))
    cos = F.when((F.col("xx") > 0) & (F.col("cc") > 0), F.col("dot") / (F.sqrt("xx") * F.sqrt("cc")))
    return g.select(group, key, cos.alias("cosine"))
