"""Scoring: keyword deltas (C6, D8, H4), the scoring request/response columns
(J1, J2, H5-H7), retry schedule (J4) and the pluggable batch scorer (J3).
Term relevance (J5, J13) is in ``relevance``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import clamp, strip_code_fence, truncate_int

ENTITY_BOOST_CAP = 20
MAX_ATTEMPTS = 3
BASE_RETRY_WAIT_S = 5
UNAVAILABLE = "Scoring unavailable"
SCORE_GUIDE = ("Below 30 means unsuitable, 30 to 55 a partial fit, 56 to 75 a good fit, above 75 an excellent one. "
               "Use the whole scale and prefer exact marks such as 63 to round ones.")


# --------------------------------------------------------------------------- keyword delta

def keyword_delta(description, boost, penalize) -> Column:
    """C6 + D8: sum the weights of keywords found (case-insensitive substring, no
    word boundary; blank keywords skipped; a keyword listed twice counts twice),
    then clamp to +-20. Runs per row over the profile's small keyword arrays,
    so there is no join between listings and keywords at all."""
    d = F.lower(F.coalesce(F.col(description) if isinstance(description, str) else description, F.lit("")))
    kws = F.concat(F.coalesce(F.col(boost) if isinstance(boost, str) else boost, F.array()),
                   F.coalesce(F.col(penalize) if isinstance(penalize, str) else penalize, F.array()))
    hit = F.filter(kws, lambda k: (F.coalesce(k["keyword"], F.lit("")) != "")
                   & F.contains(d, F.lower(k["keyword"])))
    raw = F.aggregate(hit, F.lit(0.0), lambda acc, k: acc + F.coalesce(k["weight"], F.lit(0.0)))
    return clamp(raw, -ENTITY_BOOST_CAP, ENTITY_BOOST_CAP)


def adjust(raw_score, delta) -> Column:
    """``clamp(raw + delta, 0, 100)``."""
    return clamp(F.col(raw_score).cast("double") + delta, 0.0, 100.0)


def boost_reason(reason, raw_score, adjusted) -> Column:
    """H4: append ``[+Npts entity boost]`` when the half-even rounded change is non-zero."""
    d = F.bround(F.col(adjusted) - F.col(raw_score).cast("double"), 0).cast("bigint")
    sign = F.when(d > 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(d != 0, F.concat(F.col(reason), F.lit(" ["), sign, d.cast("string"), F.lit("pts entity boost]"))) \
        .otherwise(F.col(reason))


# --------------------------------------------------------------------------- requests / responses

def scoring_request(profile_resume, profile_description, feedback, title, employer, location, description) -> Column:
    """The scoring request text for one (profile, listing) pair; the
    candidate block is JSON without NULL fields (H8)."""
    cand = F.to_json(F.struct(F.col(profile_resume).alias("resume"),
                              F.col(profile_description).alias("description"),
                              F.nullif(F.col(feedback), F.lit("")).alias("feedback")))
    return F.concat_ws("\n",
                       F.lit("Rate the fit between this candidate and this listing from 0 to 100."),
                       F.lit(SCORE_GUIDE),
                       F.concat(F.lit("CANDIDATE: "), cand),
                       F.concat(F.lit("TITLE: "), F.coalesce(F.col(title), F.lit(""))),
                       F.concat(F.lit("EMPLOYER: "), F.coalesce(F.col(employer), F.lit(""))),
                       F.concat(F.lit("LOCATION: "), F.coalesce(F.col(location), F.lit(""))),
                       F.concat(F.lit("DESCRIPTION: "), F.coalesce(F.col(description), F.lit(""))),
                       F.lit('Answer as JSON: {"score": <0-100>, "reason": "<why>"}'))


def parse_score(raw) -> tuple[Column, Column]:
    """Fence strip, JSON parse, integer truncation, clamp to 0..100.

    Unparseable JSON or a missing/non-numeric score gives (0.0, 'Scoring unavailable').
    """
    body = strip_code_fence(raw)
    parsed = F.from_json(body, "score string, reason string", {"mode": "PERMISSIVE"})
    n = truncate_int(parsed["score"])
    ok = n.isNotNull()
    score = F.when(ok, clamp(n, 0, 100).cast("double")).otherwise(F.lit(0.0))
    reason = F.when(ok, F.coalesce(parsed["reason"], F.lit(""))).otherwise(F.lit(UNAVAILABLE))
    return score, reason


def retryable(status) -> Column:
    """Every failed call is worth another try: transport errors and all HTTP errors."""
    s = F.col(status) if isinstance(status, str) else status
    return (s == "transport") | F.coalesce(s.try_cast("int") >= 400, F.lit(False))


def retry_eligible(attempts: DataFrame, request_col: str = "request_id") -> DataFrame:
    """Latest attempt per request (``max_by``: partial aggregation, no window);
    eligible when its status is retryable and fewer than 3 attempts were made;
    the next try is due ``5 * 2^(attempt-1)`` seconds after it."""
    last = attempts.groupBy(request_col).agg(
        F.max_by(F.struct("attempt", "status", "at"), F.struct("attempt", "at")).alias("l"),
        F.count("*").alias("n_attempts"))
    x = last.select(request_col, "n_attempts", F.col("l.attempt").alias("attempt"),
                    F.col("l.status").alias("status"), F.col("l.at").alias("at"))
    return (x.filter(retryable("status") & (F.col("attempt") < MAX_ATTEMPTS))
            .withColumn("next_at", F.timestamp_add(
                "SECOND", (F.lit(BASE_RETRY_WAIT_S) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int"),
                F.col("at"))))


# --------------------------------------------------------------------------- batch scorer

def overlap_score(profile, listing) -> tuple[Column, Column]:
    """The stand-in scorer as built-in columns: share of the profile's words found in the listing."""
    def words(c):
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != ""))
    want = words(profile)
    share = F.when(F.size(want) > 0, F.floor(F.lit(100) * F.size(F.array_intersect(want, words(listing))) / F.size(want)))
    score = F.coalesce(share, F.lit(0)).cast("double")
    return score, F.concat(score.cast("int").cast("string"), F.lit("% of profile words present"))


def batch_score(requests: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
                key_cols=("profile_id", "job_url")) -> DataFrame:
    """The built-in ``overlap_score``, or a user's ``scorer`` over Arrow batches with ``mapInPandas``. The callable
    is shipped once per task; it gets columns ``resume`` and ``description``
    and returns ``score`` and ``reason`` for the same rows. Repartition the
    input beforehand to bound how many scorers run at once."""
    keys = list(key_cols)
    if scorer is None:
        score, reason = overlap_score("resume", "description")
        return requests.select(*keys, score.alias("score"), reason.alias("reason"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = scorer(pdf)
            yield pd.concat([pdf[keys].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    schema = ", ".join(f"{k} {dict(requests.dtypes)[k]}" for k in keys) + ", score double, reason string"
    return requests.select(*keys, "resume", "description").mapInPandas(run, schema)
