"""Digest header and message rendering (D7, H14-H18, A13) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score colour bar and colours.
SCORE_GREEN_AT = 70
GREEN = "#22c55e"
YELLOW = "#eab308"


def html_escape(c: Column) -> Column:
    """Escape ``& < > "`` (the reference leaves values raw; we do not)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def score_colour(score) -> Column:
    """Green at 70 and above, else yellow."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= SCORE_GREEN_AT, F.lit(GREEN)).otherwise(F.lit(YELLOW))


def badge_text(job_type) -> Column:
    """Underscores to spaces; every letter after a non-letter is a capital, the rest are small."""
    j = F.col(job_type) if isinstance(job_type, str) else job_type
    runs = F.split(F.lower(F.replace(j, F.lit("_"), F.lit(" "))), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))),
                                                             F.substr(r, F.lit(2)))), "")


def long_date(ts, tz) -> Column:
    """Zone-local ``Month dd, yyyy``."""
    t = F.col(ts) if isinstance(ts, str) else ts
    z = F.col(tz) if isinstance(tz, str) else tz
    return F.date_format(F.from_utc_timestamp(t, z), "MMMM dd, yyyy")


def fill_template(template, count, top_score) -> Column:
    """Fill ``{count}`` and ``{top_score}``."""
    t = F.col(template) if isinstance(template, str) else template
    return F.replace(F.replace(t, F.lit("{count}"), count.cast("string")),
                     F.lit("{top_score}"), top_score.cast("string"))


def card(pos="pos") -> Column:
    """One listing card (H18). Remote and job-type badges, posted date if known."""
    badges = F.concat(
        F.when(F.coalesce(F.col("is_remote"), F.lit(False)), F.lit("<b class='badge'>Remote</b>")).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("job_type"), F.lit("")) != "",
               F.concat(F.lit("<b class='badge'>"), html_escape(badge_text("job_type")), F.lit("</b>")))
        .otherwise(F.lit("")))
    posted = F.when(F.coalesce(F.col("date_posted"), F.lit("")) != "",
                    F.concat(F.lit(" | posted "), html_escape(F.col("date_posted")))).otherwise(F.lit(""))
    return F.concat(
        F.lit("<li><span style='background:"), score_colour("score"), F.lit("'>"),
        F.col("score").cast("string"), F.lit("/100</span>"), badges,
        F.lit("<h3>"), html_escape(F.coalesce(F.col("title"), F.lit(""))), F.lit("</h3><p>"),
        html_escape(F.coalesce(F.col("company"), F.lit(""))), F.lit(" | "),
        html_escape(F.coalesce(F.col("location"), F.lit(""))), posted,
        F.lit("</p><a href='"), html_escape(F.col("job_url")), F.lit("'>View</a></li>"))


def digest_messages(top: DataFrame, profiles: DataFrame, as_of: str, pos: str = "pos") -> DataFrame:
    """D7 + A13: one outbox row per profile from its ranked digest rows.

    The per-profile group is at most ``max_jobs_per_email`` rows (already cut),
    so collecting it inside the aggregate is bounded.
    """
    cards = top.select("profile_id", F.col(pos).alias("_pos"), "score", card().alias("_card"))
    agg = cards.groupBy("profile_id").agg(
        F.count("*").alias("job_count"),
        F.min_by("score", "_pos").alias("top_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_card"))),
                                 lambda s: s["_card"]), "\n").alias("cards"))
    p = profiles.select("profile_id", F.col("notification.timezone").alias("tz"),
                        F.col("notification.email_subject").alias("subject_t"),
                        F.col("notification.telegram_message").alias("chat_t"))
    x = agg.join(p, "profile_id")
    day = long_date(F.lit(as_of).cast("timestamp"), F.coalesce(F.col("tz"), F.lit("UTC")))
    return x.select(
        "profile_id", "job_count", "top_score",
        fill_template("subject_t", F.col("job_count"), F.col("top_score")).alias("subject"),
        fill_template("chat_t", F.col("job_count"), F.col("top_score")).alias("chat_text"),
        F.concat(F.lit("<html><body><h1>"), F.col("job_count").cast("string"),
                 F.lit(" new jobs today</h1><p>Top match: "), F.col("top_score").cast("string"),
                 F.lit("/100 | "), day, F.lit("</p><ul>"), F.col("cards"),
                 F.lit("</ul></body></html>")).alias("html"),
    )
