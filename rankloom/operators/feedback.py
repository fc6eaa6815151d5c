"""Feedback state and what is mined from it (G4, B11-B15, D1, D9, D10, E5, F3,
F4, H22, H23, J8, J10).

User actions are an append-only event log. The current state per
(profile, listing) is a fold: for each kind, the value of the latest event by
``(ts, seq)``. ``max_by`` is a declarative aggregate, so the fold runs with
partial aggregation before the shuffle; a listing with millions of events
costs one buffer per map task, not one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators import filters as B
from rankloom.operators.ranking import top_n_per_group

KINDS = ("rate", "note", "applied", "hide")
FEEDBACK_WINDOW = 200
SUMMARY_WINDOW = 100
SUMMARY_DAYS = 90
CLASS_CAPS = {"liked": 50, "disliked": 50, "noted": 30}
CLASS_ORDER = {"liked": 1, "disliked": 2, "noted": 3}
INSIGHTS_THRESHOLD = 10


def _latest(kind: str, valid: Column | None = None) -> Column:
    cond = F.col("kind") == kind
    if valid is not None:
        cond = cond & valid
    return F.max_by(F.col("value"), F.when(cond, F.struct("ts", "seq")))


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """Current state per key. Rating 0 clears (NULL), an empty note clears,
    invalid ratings are ignored (see ``invalid``)."""
    rating_ok = B.valid_rating(F.col("value").try_cast("int"))
    g = events.groupBy(*keys).agg(
        _latest("rate", rating_ok).alias("_rate"),
        _latest("note").alias("_note"),
        _latest("applied").alias("_applied"),
        _latest("hide").alias("_hide"),
        F.max(F.when((F.col("kind") == "rate") & rating_ok, F.lit(True))).alias("has_rating"),
        F.max(F.when(F.col("kind") == "note", F.lit(True))).alias("has_note"),
    )
    return g.select(
        *keys,
        F.nullif(F.col("_rate").cast("int"), F.lit(0)).alias("user_rating"),
        F.nullif(F.col("_note"), F.lit("")).alias("notes"),
        F.coalesce(F.col("_applied") == "1", F.lit(False)).alias("is_applied"),
        (F.col("_hide") == "1").alias("hidden"),
        F.coalesce("has_rating", F.lit(False)).alias("has_rating"),
        F.coalesce("has_note", F.lit(False)).alias("has_note"),
    )


def latest_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The fold in a form that later events can be added to: per key and kind the
    latest valid value with its ``(ts, seq)``; ``state_of`` reads it."""
    rating_ok = B.valid_rating(F.col("value").try_cast("int"))

    def latest(kind: str) -> Column:
        mine = (F.col("kind") == kind) & (rating_ok if kind == "rate" else F.lit(True))
        return F.max(F.when(mine, F.struct(F.struct("ts", "seq").alias("at"), "value"))).alias(kind)

    return events.groupBy(*keys).agg(*[latest(k) for k in KINDS])


def newer_of(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two folds of ``latest_events`` as one: per kind the later event."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.max(k).alias(k) for k in KINDS])


def state_of(latest: DataFrame) -> DataFrame:
    """The columns of ``fold`` that follow from ``latest_events``."""
    keys = [c for c in latest.columns if c not in KINDS]
    return latest.select(*keys, F.nullif(F.col("rate.value").cast("int"), F.lit(0)).alias("user_rating"),
                         F.nullif(F.col("note.value"), F.lit("")).alias("notes"),
                         F.coalesce(F.col("applied.value") == "1", F.lit(False)).alias("is_applied"),
                         (F.col("hide.value") == "1").alias("hidden"))


def invalid(events: DataFrame) -> DataFrame:
    """Rating events outside {-1, 0, 1}, set aside with a reason."""
    bad = (F.col("kind") == "rate") & ~B.valid_rating(F.col("value").try_cast("int"))
    return events.filter(bad).withColumn("reason", F.lit("rating must be -1, 0 or 1"))


def apply_state(jobs: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Left join the folded state onto listings: a folded value replaces the
    stored one; an unknown listing in the log is a no-op (it has no row)."""
    s = state.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in
                              ("user_rating", "notes", "is_applied", "hidden", "has_rating", "has_note")])
    x = jobs.join(s, keys, "left")
    base = {c: (F.col(c) if c in jobs.columns else F.lit(None)) for c in ("user_rating", "notes", "is_applied", "hidden")}
    out = x.withColumn("user_rating", F.when(F.coalesce("_s_has_rating", F.lit(False)), F.col("_s_user_rating"))
                       .otherwise(base["user_rating"]).cast("int"))
    out = out.withColumn("notes", F.when(F.coalesce("_s_has_note", F.lit(False)), F.col("_s_notes"))
                         .otherwise(base["notes"]).cast("string"))
    out = out.withColumn("is_applied", F.coalesce("_s_is_applied", base["is_applied"], F.lit(False)))
    out = out.withColumn("hidden", F.when(F.col("_s_hidden").isNotNull(), F.col("_s_hidden"))
                         .otherwise(base["hidden"]).cast("boolean"))
    return out.drop(*[c for c in out.columns if c.startswith("_s_")])


def rating_word(r) -> Column:
    """H23."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when(r == 1, "liked").when(r == -1, "disliked").otherwise("noted")


def feedback_line() -> Column:
    """``title at employer (score N), Remote, Type. Note: ...``."""
    return F.concat(
        F.coalesce(F.col("title"), F.lit("")), F.lit(" at "), F.coalesce(F.col("employer"), F.lit("")),
        F.lit(" (score "), F.coalesce(F.col("score").cast("string"), F.lit("?")), F.lit(")"),
        F.when(F.coalesce(F.col("is_remote"), F.lit(False)), F.lit(", Remote")).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("job_type"), F.lit("")) != "", F.concat(F.lit(", "), F.col("job_type"))).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("notes"), F.lit("")) != "", F.concat(F.lit(". Note: "), F.col("notes"))).otherwise(F.lit("")))


def newest_feedback(state_rows: DataFrame) -> DataFrame:
    """F3 + B11 + B13: per profile the newest 200 rated-or-noted, strictly visible rows."""
    rows = state_rows.filter(B.rated_or_noted() & B.strictly_visible("hidden"))
    return top_n_per_group(rows, ["profile_id"], [F.col("discovered_at").desc(), F.col("job_url")],
                           FEEDBACK_WINDOW, rank_col="_age")


def sections(state_rows: DataFrame) -> DataFrame:
    """D9 + E5 + F3: per profile, the newest 200 rated-or-noted, strictly
    visible rows (B13), capped per class (liked 50, disliked 50, noted 30),
    rendered as text sections; empty sections are left out."""
    newest = newest_feedback(state_rows)
    cls = rating_word("user_rating")
    cap = F.element_at(F.create_map(*[x for k, v in CLASS_CAPS.items() for x in (F.lit(k), F.lit(v))]), cls)
    classed = newest.withColumn("cls", cls).withColumn("cap", cap)
    capped = top_n_per_group(classed, ["profile_id", "cls"], [F.col("_age")], F.col("cap"), rank_col="_rn")
    per_class = (capped.withColumn("line", F.concat(F.lit("- "), feedback_line()))
                 .groupBy("profile_id", "cls")
                 .agg(F.array_sort(F.collect_list(F.struct("_rn", "line"))).alias("_l"), F.count("*").alias("n")))
    order = F.element_at(F.create_map(*[x for k, v in CLASS_ORDER.items() for x in (F.lit(k), F.lit(v))]), F.col("cls"))
    sec = per_class.select("profile_id", order.alias("o"), "n", F.concat(
        F.initcap("cls"), F.lit(":\n"), F.array_join(F.transform("_l", lambda s: s["line"]), "\n")).alias("text"))
    return (sec.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "text"))).alias("_s"), F.sum("n").alias("n_rows"))
        .select("profile_id", "n_rows", F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n").alias("sections")))


def summary(state_rows: DataFrame, as_of: str, parity: bool = True, n_employers: int = 3) -> DataFrame:
    """J10 + B12 + F4: per profile, over the newest 100 rated-or-noted rows of
    the last 90 days: liked/disliked counts, remote share among liked, the
    ``n_employers`` most liked employers, and a one-line text."""
    as_of_ts = F.lit(as_of).cast("timestamp")
    if parity:
        recent = F.to_date("discovered_at") >= F.date_sub(F.to_date(as_of_ts), SUMMARY_DAYS)
    else:
        recent = F.col("discovered_at") >= F.timestamp_add("DAY", F.lit(-SUMMARY_DAYS), as_of_ts)
    rows = state_rows.filter(B.rated_or_noted() & recent)
    newest = top_n_per_group(rows, ["profile_id"], [F.col("discovered_at").desc(), F.col("job_url")],
                             SUMMARY_WINDOW, rank_col="_age")
    liked = F.col("user_rating") == 1
    counts = newest.groupBy("profile_id").agg(
        F.count_if(liked).alias("n_liked"), F.count_if(F.col("user_rating") == -1).alias("n_disliked"),
        F.count_if(liked & F.coalesce(F.col("is_remote"), F.lit(False))).alias("_liked_remote"))
    emp = (newest.filter(liked).groupBy("profile_id", "employer").agg(F.count("*").alias("c")))
    top_emp = (top_n_per_group(emp, ["profile_id"], [F.col("c").desc(), F.col("employer")], n_employers, rank_col="r")
               .groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("r", "employer"))).alias("_e"))
               .select("profile_id", F.array_join(F.transform("_e", lambda s: s["employer"]), ", ").alias("top_employers")))
    x = counts.join(top_emp, "profile_id", "left")
    share = F.when(F.col("n_liked") > 0, F.round(F.col("_liked_remote") / F.col("n_liked"), 4)).otherwise(F.lit(0.0))
    return x.select(
        "profile_id", "n_liked", "n_disliked", share.alias("remote_share"),
        F.coalesce("top_employers", F.lit("")).alias("top_employers"),
        F.concat(F.lit("Liked "), F.col("n_liked").cast("string"), F.lit(", disliked "),
                 F.col("n_disliked").cast("string"), F.lit("; liked employers: "),
                 F.coalesce(F.nullif(F.col("top_employers"), F.lit("")), F.lit("none"))).alias("summary"))


def insights_counter(state: DataFrame, processed: DataFrame) -> DataFrame:
    """D1 + D10: rated-or-noted rows now, minus those processed at the last
    insights run (missing meta = 0); ready when at least 10 are new."""
    cur = state.groupBy("profile_id").agg(F.count_if(B.rated_or_noted()).alias("current"))
    x = cur.join(processed, "profile_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)).cast("bigint"))
    new = F.greatest(F.lit(0).cast("bigint"), F.col("current") - F.col("processed"))
    return x.select("profile_id", "current", "processed", new.alias("new_feedback"),
                    (new >= INSIGHTS_THRESHOLD).alias("ready"))
