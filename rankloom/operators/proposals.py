"""Profile-change proposals: suggestion (J8, J11), apply (C9, G2, D6), revert
(C10, G6, B16), texts (H24, H27) and revision by reply (J12, H25).

A profile's keyword and term lists are short arrays inside its row, so apply
and revert are per-row array expressions: the case-insensitive anti join of
proposed against existing items happens inside the row, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import list_text, tokens
from rankloom.operators.ranking import top_n_per_group
from rankloom.session import materialize

MAX_SUGGESTIONS = 5
BOOST_RANGE = (1, 20)
PENALTY_RANGE = (-50, -10)
TERMS_PER_TASK = 250_000


def suggest_keywords(rated: DataFrame, profiles: DataFrame) -> DataFrame:
    """Contrast how many liked vs disliked listings' titles use a term
    (smoothed log-odds), drop terms the profile already has (any case), keep
    the top 5 each way, scale to boost 1..20 / penalty -50..-10. ``rated`` holds a
    listing once per profile, and a bounded window of them (F3), so its rows are
    dealt by profile once, in as many parts as their terms ask for, and every step
    below stays in place."""
    like, dislike = F.count_if(F.col("user_rating") == 1), F.count_if(F.col("user_rating") == -1)
    rated = materialize(rated.select("profile_id", "user_rating", F.array_distinct(tokens("title")).alias("terms")), "rated-terms")
    # A task holds one row per profile and term. Parts made by size alone would hold ever more of
    # them, as they are cut by the bytes of the packed arrays; a given number of parts is kept.
    held = rated.agg(F.sum(F.greatest(F.size("terms"), F.lit(1)))).first()[0] or 0
    rated = rated.repartition(max(1, -(-held // TERMS_PER_TASK)), "profile_id")
    n = rated.groupBy("profile_id").agg(like.alias("nl"), dislike.alias("nd"))
    tf = (rated.select("profile_id", "user_rating", F.explode("terms").alias("term"))
          .groupBy("profile_id", "term").agg(like.alias("l"), dislike.alias("d")))
    # rounded so that equal odds tie exactly and the term breaks the tie
    s = F.round(F.ln((F.col("l") + 1) / (F.col("nl") + 2)) - F.ln((F.col("d") + 1) / (F.col("nd") + 2)), 9)
    have = F.transform(F.concat(F.coalesce("scoring.boost", F.array()), F.coalesce("scoring.penalize", F.array())),
                       lambda k: F.lower(k["keyword"]))
    sc = tf.join(n, "profile_id").select("profile_id", "term", s.alias("s"))
    x = sc.join(profiles.select("profile_id", have.alias("_have")), "profile_id", "left")
    fresh = x.filter(~F.coalesce(F.array_contains("_have", F.col("term")), F.lit(False))).drop("_have")
    w = F.round(F.col("s") * 10)
    boost = top_n_per_group(fresh.filter(F.col("s") > 0), ["profile_id"], [F.col("s").desc(), F.col("term")],
                            MAX_SUGGESTIONS, rank_col="rank").select(
        "profile_id", F.lit("boost").alias("kind"), "rank", F.col("term").alias("keyword"),
        F.greatest(F.lit(BOOST_RANGE[0]), F.least(F.lit(BOOST_RANGE[1]), w)).cast("int").alias("weight"))
    pen = top_n_per_group(fresh.filter(F.col("s") < 0), ["profile_id"], [F.col("s").asc(), F.col("term")],
                          MAX_SUGGESTIONS, rank_col="rank").select(
        "profile_id", F.lit("penalize").alias("kind"), "rank", F.col("term").alias("keyword"),
        F.greatest(F.lit(PENALTY_RANGE[0]), F.least(F.lit(PENALTY_RANGE[1]), w)).cast("int").alias("weight"))
    return boost.unionByName(pen).withColumn("rank", F.col("rank").cast("bigint"))


def _new_items(existing: Column, proposed: Column, key=lambda x: x) -> Column:
    """Proposed items whose lower-cased key is not among the existing ones
    (duplicates inside one proposal are all kept, as in the reference)."""
    have = F.transform(F.coalesce(existing, F.array()), lambda e: F.lower(key(e)))
    return F.filter(F.coalesce(proposed, F.array()), lambda p: ~F.array_contains(have, F.lower(key(p))))


def apply(profiles: DataFrame, proposals: DataFrame) -> DataFrame:
    """C9 + G2 + D6: add proposed items not yet present (any case) to the end
    of the profile's lists; report the added items and a change text."""
    x = profiles.join(proposals, "profile_id")
    kw = lambda e: F.coalesce(e["keyword"], F.lit(""))
    x = (x.withColumn("boost_added", _new_items(F.col("scoring.boost"), F.col("boost_add"), kw))
         .withColumn("penalize_added", _new_items(F.col("scoring.penalize"), F.col("penalize_add"), kw))
         .withColumn("terms_added", _new_items(F.col("search.terms"), F.col("terms_add"))))
    x = (x.withColumn("scoring", F.col("scoring")
                      .withField("boost", F.concat(F.coalesce("scoring.boost", F.array()), "boost_added"))
                      .withField("penalize", F.concat(F.coalesce("scoring.penalize", F.array()), "penalize_added")))
         .withColumn("search", F.col("search").withField(
             "terms", F.concat(F.coalesce("search.terms", F.array().cast("array<string>")), "terms_added"))))
    return x.withColumn("change_text", change_text("boost_added", "penalize_added", "terms_added"))


def change_text(boost, penalize, terms) -> Column:
    """``2 boost keyword(s), 1 search term(s)``; ``no new items`` when nothing."""
    parts = [F.when(F.size(boost) > 0, F.concat(F.size(boost).cast("string"), F.lit(" boost keyword(s)"))),
             F.when(F.size(penalize) > 0, F.concat(F.size(penalize).cast("string"), F.lit(" penalize keyword(s)"))),
             F.when(F.size(terms) > 0, F.concat(F.size(terms).cast("string"), F.lit(" search term(s)")))]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("no new items"))


def revert(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """C10 + B16: remove from the profile every item (any case) a history
    entry added; count what was removed. Entries already reverted are refused
    with a reason instead of being applied again."""
    x = profiles.join(entries, "profile_id")
    valid = ~F.coalesce(F.col("reverted"), F.lit(False))
    kw = lambda e: F.lower(F.coalesce(e["keyword"], F.lit("")))

    def keep(current, added, key):
        gone = F.transform(F.coalesce(added, F.array()), key)
        return F.filter(F.coalesce(current, F.array()), lambda c: ~F.array_contains(gone, key(c)))

    nb = keep(F.col("scoring.boost"), F.col("boost_added"), kw)
    npn = keep(F.col("scoring.penalize"), F.col("penalize_added"), kw)
    nt = keep(F.col("search.terms"), F.col("terms_added"), lambda t: F.lower(t))
    removed = ((F.size(F.coalesce("scoring.boost", F.array())) - F.size(nb))
               + (F.size(F.coalesce("scoring.penalize", F.array())) - F.size(npn))
               + (F.size(F.coalesce("search.terms", F.array())) - F.size(nt)))
    return x.select(
        "profile_id", "entry_id",
        F.when(valid, nb).otherwise(F.col("scoring.boost")).alias("boost"),
        F.when(valid, npn).otherwise(F.col("scoring.penalize")).alias("penalize"),
        F.when(valid, nt).otherwise(F.col("search.terms")).alias("terms"),
        F.when(valid, removed).otherwise(F.lit(0)).alias("removed"),
        F.when(valid, F.lit(None)).otherwise(F.lit("already reverted")).cast("string").alias("refused"),
        F.lit(True).alias("reverted"))


def history(entries: DataFrame) -> DataFrame:
    """applied proposals newest first; ``position`` counts from 0 per profile."""
    w = Window.partitionBy("profile_id").orderBy(F.col("applied_at").desc(), F.col("entry_id").desc())
    return entries.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def revert_requests(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """B16 + G6: ``requests(request_id, profile_id, position)`` against the history.

    ``outcome`` is ``reverted``, ``already reverted`` (before, or by an earlier
    request of the same entry) or ``not found`` (no such position). An entry
    that was reverted stays so."""
    h = history(entries).select("profile_id", "position", "entry_id", "reverted")
    x = requests.join(h, ["profile_id", "position"], "left")
    first = F.min("request_id").over(Window.partitionBy("profile_id", "position"))
    outcome = (F.when(F.col("entry_id").isNull(), "not found")
               .when(F.col("reverted") | (F.col("request_id") > first), "already reverted").otherwise("reverted"))
    return x.select("request_id", "profile_id", "position", "entry_id", outcome.alias("outcome"))


def proposal_text(summary, boost_add, penalize_add, terms_add) -> Column:
    """H27 + H24: the proposal message body; empty lists have no line."""
    def line(label, items, field=None):
        a = F.col(items) if isinstance(items, str) else items
        return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit(label), list_text(a, field)))

    changes = F.concat_ws("\n", line("Boost: ", boost_add, "keyword"), line("Penalize: ", penalize_add, "keyword"),
                          line("New search terms: ", terms_add))
    return F.concat_ws(
        "\n",
        F.coalesce(F.col(summary) if isinstance(summary, str) else summary, F.lit("")),
        F.lit(""),
        F.coalesce(F.nullif(changes, F.lit("")), F.lit("Nothing to change right now.")),
        F.lit(""),
        F.lit("Reply yes to apply, no to discard, or tell me what to change."))


def transcript(conversation) -> Column:
    """``AI: ...`` / ``User: ...`` lines from an ordered conversation array."""
    c = F.col(conversation) if isinstance(conversation, str) else conversation
    return F.array_join(F.transform(c, lambda m: F.concat(
        F.when(m["role"] == "assistant", F.lit("AI")).otherwise(F.lit("User")), F.lit(": "), m["content"])), "\n")


def revise(proposals: DataFrame, replies: DataFrame, key: str = "profile_id") -> DataFrame:
    """Append the reply to the conversation and edit the lists by the
    reply's ``add X`` / ``drop X`` commands (one per line)."""
    x = proposals.join(replies, key)
    lines = F.split(F.col("reply"), r"\r\n|\r|\n")
    adds = F.transform(F.filter(lines, lambda l: F.lower(F.trim(l)).startswith("add ")),
                       lambda l: F.trim(F.substr(F.trim(l), F.lit(5))))
    drops = F.transform(F.filter(lines, lambda l: F.lower(F.trim(l)).startswith("drop ")),
                        lambda l: F.lower(F.trim(F.substr(F.trim(l), F.lit(6)))))
    kept = F.filter(F.coalesce("terms_add", F.array().cast("array<string>")),
                    lambda t: ~F.array_contains(drops, F.lower(t)))
    return x.select(
        key,
        F.concat(F.coalesce("conversation", F.array()),
                 F.array(F.struct(F.lit("user").alias("role"), F.col("reply").alias("content")))).alias("conversation"),
        F.concat(kept, adds).alias("terms_add"))


COMMAND = r"(?i)^\s*(add|drop|boost|penalize)\s+(.*?)(?:\s+(-?\d+))?\s*$"
DEFAULT_WEIGHT = {"boost": 10, "penalize": -20}


def revise_lists(x: DataFrame, reply: str) -> DataFrame:
    """J12 on all lists: the reply joins ``conversation``; its lines ``add X`` (a
    search term), ``boost X [n]``, ``penalize X [n]`` and ``drop X`` (from every
    list, any case) edit ``terms_add``, ``boost_add`` and ``penalize_add``. Weights
    are clamped to their range, a penalty's sign does not matter; other lines
    change nothing."""
    part = lambda line, k: F.regexp_extract(line, COMMAND, k)
    said = F.transform(F.split(F.coalesce(F.col(reply), F.lit("")), r"\r\n|\r|\n"), lambda line: F.struct(
        F.lower(part(line, 1)).alias("verb"), part(line, 2).alias("what"), part(line, 3).try_cast("int").alias("n")))
    x = x.withColumn("_said", F.filter(said, lambda c: (c["verb"] != "") & (c["what"] != "")))

    def items(verb, low, high):
        asked = F.filter("_said", lambda c: c["verb"] == verb)
        sign = -1 if high < 0 else 1
        return F.transform(asked, lambda c: F.struct(c["what"].alias("keyword"), F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(
            sign * F.abs(c["n"]), F.lit(DEFAULT_WEIGHT[verb])))).cast("double").alias("weight")))

    dropped = F.transform(F.filter("_said", lambda c: c["verb"] == "drop"), lambda c: F.lower(c["what"]))
    x = x.withColumn("_dropped", dropped)
    stays = lambda k: ~F.array_contains("_dropped", F.lower(k))
    keywords = lambda c: F.coalesce(c, F.array().cast("array<struct<keyword:string,weight:double>>"))
    terms = F.transform(F.filter("_said", lambda c: c["verb"] == "add"), lambda c: F.concat_ws(" ", c["what"], c["n"].cast("string")))
    return (x.withColumn("boost_add", F.concat(F.filter(keywords("boost_add"), lambda e: stays(e["keyword"])), items("boost", *BOOST_RANGE)))
            .withColumn("penalize_add", F.concat(F.filter(keywords("penalize_add"), lambda e: stays(e["keyword"])), items("penalize", *PENALTY_RANGE)))
            .withColumn("terms_add", F.concat(F.filter(F.coalesce("terms_add", F.array().cast("array<string>")), stays), terms))
            .withColumn("conversation", F.concat(F.coalesce("conversation", F.array()), F.array(F.struct(
                F.lit("user").alias("role"), F.col(reply).alias("content")))))
            .drop("_said", "_dropped"))
