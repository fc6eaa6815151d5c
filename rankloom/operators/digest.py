"""Digest selection: fresh, well scored, not yet sent, top N per profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import filters as B
from rankloom.operators.ranking import top_n_per_group

# Lookup-time defaults of the digest job.
DIGEST_DEFAULTS = {
    "score_threshold": 60,
    "max_job_age_days": 7,
    "rerank_candidates": 30,
    "rerank_min_score": 0.3,
    "max_jobs_per_email": 5,
}


def with_settings(jobs: DataFrame, profiles: DataFrame | None = None, **overrides) -> DataFrame:
    """Attach per-profile notification settings (``profiles.notification``) with
    digest defaults for missing values; without ``profiles`` use constants."""
    vals = {**DIGEST_DEFAULTS, **overrides}
    if profiles is None:
        return jobs.select("*", *[F.lit(v).alias(k) for k, v in vals.items()])
    p = profiles.select(
        "profile_id",
        *[F.coalesce(F.col(f"notification.{k}"), F.lit(v)).alias(k) for k, v in vals.items()])
    return jobs.join(p, "profile_id")


def candidates(jobs: DataFrame, ledger: DataFrame | None, as_of: str, parity: bool = True,
               profiles: DataFrame | None = None) -> DataFrame:
    """B4-B7 and C2. ``jobs`` carries its profile's settings as columns, or gets
    them from ``profiles``; without a ``ledger`` it is what ``unsent`` has left.

    The row filters come first. "Not in the ledger" is a left join that keeps
    the rows without a match, because an anti join would be moved below the
    join that brings the settings, and so below the filters that use them.
    """
    if profiles is not None:
        jobs = with_settings(jobs, profiles)
    cond = B.score_at_least("score", "score_threshold")
    if "user_rating" in jobs.columns:
        cond = cond & B.not_disliked("user_rating")
    if "hidden" in jobs.columns:
        cond = cond & B.visible("hidden")
    cond = cond & B.fresh("date_posted", "discovered_at", as_of, F.col("max_job_age_days"), parity=parity)
    if ledger is None:
        return jobs.filter(cond)
    sent = ledger.select("profile_id", "job_url").distinct().withColumn("_sent", F.lit(True))
    return jobs.filter(cond).join(sent, ["profile_id", "job_url"], "left").filter(F.col("_sent").isNull()).drop("_sent")


def unsent(jobs: DataFrame, ledger: DataFrame, near: str) -> DataFrame:
    """C2 by ``near``, a column of both frames that equal URLs share: a row's URL is
    looked up among those sent with its value of ``near``, which must be few. Frames
    dealt by ``near`` stay in place, so this comes before the settings, which deal
    the listings by profile."""
    pair = F.struct("profile_id", "job_url")
    sent = (ledger.filter(F.col("profile_id").isNotNull() & F.col("job_url").isNotNull())
            .groupBy(near).agg(F.collect_set(pair).alias("_sent")))
    return (jobs.join(sent, near, "left")
            .filter(~F.coalesce(F.array_contains("_sent", pair), F.lit(False))).select(*jobs.columns))


def score_order():
    """F1: score descending, then URL as our tie-break."""
    return [F.col("score").desc_nulls_last(), F.col("job_url").asc()]


def top_by_score(cands: DataFrame, n, rank_col: str = "pos", most: int | None = None) -> DataFrame:
    """E2/E3 in score order (no re-ranker); ``most``: the largest ``n`` where known."""
    return top_n_per_group(cands, ["profile_id"], score_order(), n, rank_col=rank_col,
                           salt_on=["job_url"], most=most).withColumn(rank_col, F.col(rank_col).cast("bigint"))


def largest(profiles: DataFrame, *settings: str) -> int:
    """The largest value that any of the ``settings`` has, with the defaults; one small job."""
    x = with_settings(profiles.select("profile_id"), profiles)
    return x.agg(F.max(F.greatest(*[F.col(s) for s in settings], F.lit(0)))).first()[0] or 0


def per_source_budget(cands: DataFrame, source_col: str, budget: int, n, rank_col: str = "pos",
                      most: int | None = None) -> DataFrame:
    """At most ``budget`` rows per (profile, source), then top ``n`` per profile."""
    capped = top_n_per_group(cands, ["profile_id", source_col], score_order(), budget, rank_col="_src_rank")
    return top_by_score(capped.drop("_src_rank"), n, rank_col, most)


def preview(cands: DataFrame, n: int, parity: bool = True, rank_col: str = "pos") -> DataFrame:
    """Preview top N without re-ranking; the reference appends before it
    tests the count, so N = 0 still yields one row (parity)."""
    return top_by_score(cands, max(1, n) if parity else n, rank_col)


def ledger_append(ledger: DataFrame, sent: DataFrame, sent_at: str) -> DataFrame:
    """Insert-or-ignore ``sent`` into the ledger; the earliest time survives.

    Written as an anti join + union so existing rows never move; re-running
    with the same batch adds nothing.
    """
    new = (sent.select("profile_id", "job_url").dropDuplicates()
           .join(ledger.select("profile_id", "job_url"), ["profile_id", "job_url"], "left_anti")
           .withColumn("sent_at", F.lit(sent_at).cast("timestamp")))
    return ledger.select("profile_id", "job_url", "sent_at").unionByName(new)
