"""Row predicates (B1-B17) as Column expressions.

All of them are built-in expressions, so they stay inside whole-stage codegen
and, where the column is a plain parquet column, push into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DATES = ("nan", "")
STALE_DATE_POSTED_DAYS = 14


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region_ok(location, is_remote, allowed_regions) -> Column:
    """B1: no list (NULL or empty) passes, remote passes, else some region is a
    case-insensitive substring of the location."""
    loc, rem, regions = _c(location), _c(is_remote), _c(allowed_regions)
    hit = F.exists(regions, lambda r: F.contains(F.lower(F.coalesce(loc, F.lit(""))), F.lower(r)))
    return (F.coalesce(F.size(regions), F.lit(0)) <= 0) | F.coalesce(rem, F.lit(False)) | F.coalesce(hit, F.lit(False))


def language_ok(detected, required) -> Column:
    """B2: no requirement passes; a failed detection (NULL) passes; else equal, case-insensitive."""
    det, req = _c(detected), _c(required)
    return (F.coalesce(req, F.lit("")) == "") | det.isNull() | (F.lower(det) == F.lower(req))


def has_url(job_url) -> Column:
    """Drop rows without a URL."""
    u = _c(job_url)
    return u.isNotNull() & (u != "")


def score_at_least(score, threshold) -> Column:
    """``score >= threshold``; a NULL score never passes."""
    return F.coalesce(_c(score) >= _c(threshold), F.lit(False))


def not_disliked(user_rating) -> Column:
    """``rating IS NULL OR rating != -1``."""
    return ~_c(user_rating).eqNullSafe(F.lit(-1))


def visible(hidden) -> Column:
    """``hidden = 0 OR hidden IS NULL``."""
    return ~F.coalesce(_c(hidden), F.lit(False))


def strictly_visible(hidden) -> Column:
    """``hidden = 0``; a NULL flag is *not* visible here."""
    return F.coalesce(~_c(hidden), F.lit(False))


def date_known(date_posted) -> Column:
    d = _c(date_posted)
    return d.isNotNull() & ~d.isin(*UNKNOWN_DATES)


def fresh(date_posted, discovered_at, as_of: str, max_job_age_days,
          stale_days: int = STALE_DATE_POSTED_DAYS, parity: bool = True) -> Column:
    """B7 freshness with two branches.

    Known ``date_posted`` (a date, with or without a time) must be on or after ``as_of`` - ``stale_days`` (UTC
    day); an unparseable one drops. Unknown dates fall back to
    ``discovered_at >= as_of - max_job_age_days``. With ``parity`` the fallback
    compares whole days, as the reference's text comparison lets every row of
    the cutoff day through.
    """
    dp, disc = _c(date_posted), _c(discovered_at)
    as_of_ts = F.lit(as_of).cast("timestamp")
    known_ok = dp.try_cast("date") >= F.date_sub(F.to_date(as_of_ts), stale_days)
    age = _c(max_job_age_days) if not isinstance(max_job_age_days, int) else F.lit(max_job_age_days)
    if parity:
        fallback_ok = F.to_date(disc) >= F.date_sub(F.to_date(as_of_ts), age)
    else:
        fallback_ok = disc >= F.timestamp_add("DAY", -age, as_of_ts)
    return F.coalesce(F.when(date_known(dp), known_ok).otherwise(fallback_ok), F.lit(False))


def history_filter(name: str | None, user_rating="user_rating", is_applied="is_applied", sent="sent") -> Column:
    """Liked / disliked / applied / sent / unsent; anything else keeps all."""
    preds = {
        "liked": _c(user_rating) == 1,
        "disliked": _c(user_rating) == -1,
        "applied": _c(is_applied) == True,  # noqa: E712 - Column comparison
        "sent": _c(sent),
        "unsent": ~_c(sent),
    }
    return F.coalesce(preds.get(name or "", F.lit(True)), F.lit(False))


def escape_like(q: str) -> str:
    """Spark LIKE treats backslash as escape; ``%`` and ``_`` stay wildcards."""
    return q.replace("\\", "\\\\")


def text_search(q: str | None, *cols) -> Column:
    """Any of ``cols`` contains ``q`` by LIKE, case-insensitive; empty q keeps all."""
    if not q:
        return F.lit(True)
    pat = "%" + escape_like(q.lower()) + "%"
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(_c(c)).like(pat), F.lit(False))
    return out


def sent_on(prefix: str | None, sent_at_text) -> Column:
    """``sent_at`` text starts with the given day (or month, or year) prefix."""
    if not prefix:
        return F.lit(True)
    return F.coalesce(F.startswith(_c(sent_at_text), F.lit(prefix)), F.lit(False))


def rated_or_noted(user_rating="user_rating", notes="notes") -> Column:
    """Rated, or carrying a non-empty note."""
    return _c(user_rating).isNotNull() | (F.coalesce(_c(notes), F.lit("")) != "")


def valid_rating(value) -> Column:
    """A rating must be -1, 0 or 1."""
    return F.coalesce(_c(value).isin(-1, 0, 1), F.lit(False))
