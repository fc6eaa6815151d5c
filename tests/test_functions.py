"""Scalar helpers, response parsing, intent, feedback fold, proposals."""

from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import feedback as FB
from rankloom.operators import proposals as P
from rankloom.operators import replies as RP
from rankloom.operators import scoring as S


def test_parse_score(spark):
    raw = ['```json\n{"score": 73, "reason": "good"}\n```', '{"score": "73.9", "reason": "x"}',
           '{"score": 140, "reason": "hi"}', '{"score": -3}', "not json", '{"reason": "no score"}',
           '```\n{"score": 55, "reason": "fenced"}\n```']
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    s, r = S.parse_score(F.col("raw"))
    got = [(x.s, x.r) for x in df.select(s.alias("s"), r.alias("r")).collect()]
    assert got == [(73.0, "good"), (73.0, "x"), (100.0, "hi"), (0.0, ""), (0.0, S.UNAVAILABLE),
                   (0.0, S.UNAVAILABLE), (55.0, "fenced")]


def test_first_word_and_quotes(spark):
    df = spark.createDataFrame([("  Yes, please!",), ("",), ("'OK'.",), ("line\n> quoted\nmore",)], "t string")
    got = df.select(T.first_word("t").alias("w"), T.strip_quoted("t").alias("q")).collect()
    assert [r.w for r in got] == ["yes", "", "ok", "line"]
    assert got[3].q == "line\nmore"


def test_intent_parity_and_strict(spark):
    words = ["approve", "Yes!", "nope", "aprove", "rejct", "", "dont", "not", "tell me more", "perfecto"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = df.select(RP.intent("t").alias("p"), RP.intent("t", parity=False).alias("s")).collect()
    assert [r.p for r in got] == ["approve", "approve", "reject", "approve", "reject", "approve", "approve",
                                  "approve", "freeform", "approve"]
    # strict: no fuzzy approve from an empty word or a negation ('dont' is near 'deny')
    assert [r.s for r in got] == ["approve", "approve", "reject", "approve", "reject", "freeform", "reject",
                                  "freeform", "freeform", "approve"]


def test_feedback_fold_latest_wins(spark):
    ev = spark.createDataFrame([
        (1, 7, 1, "2024-01-01 00:00:00", "rate", "1"),
        (1, 7, 2, "2024-01-02 00:00:00", "rate", "0"),    # clears
        (1, 7, 3, "2024-01-03 00:00:00", "rate", "5"),    # invalid, ignored
        (1, 7, 4, "2024-01-01 00:00:00", "note", "hello"),
        (1, 7, 5, "2024-01-04 00:00:00", "note", ""),     # clears
        (1, 8, 6, "2024-01-01 00:00:00", "rate", "-1"),
        (1, 8, 7, "2024-01-01 00:00:00", "hide", "1"),
    ], "profile_id long, listing_id long, seq long, ts string, kind string, value string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.listing_id: r for r in FB.fold(ev, ["profile_id", "listing_id"]).collect()}
    assert got[7].user_rating is None and got[7].notes is None and got[7].has_rating
    assert got[8].user_rating == -1 and got[8].hidden is True
    assert FB.invalid(ev).count() == 1


KW = "array<struct<keyword:string,weight:double>>"


def test_apply_and_revert_are_case_insensitive(spark):
    prof = spark.createDataFrame(
        [(1, ([("HubSpot", 16.0)], [("warehouse", -25.0)]), (["sales"],))],
        f"profile_id long, scoring struct<boost:{KW},penalize:{KW}>, search struct<terms:array<string>>")
    prop = spark.createDataFrame(
        [(1, [("hubspot", 5.0), ("CRM", 11.0), ("CRM", 11.0)], [], ["Sales", "account management"])],
        f"profile_id long, boost_add {KW}, penalize_add {KW}, terms_add array<string>")
    a = P.apply(prof, prop).collect()[0]
    assert [k.keyword for k in a.boost_added] == ["CRM", "CRM"]
    assert a.terms_added == ["account management"]
    assert a.change_text == "2 boost keyword(s), 1 search term(s)"
    after = P.apply(prof, prop).select("profile_id", "scoring", "search")
    entry = P.apply(prof, prop).select("profile_id", F.lit(1).alias("entry_id"), "boost_added", "penalize_added",
                                       "terms_added", F.lit(False).alias("reverted"))
    r = P.revert(after, entry).collect()[0]
    assert r.removed == 3 and [k.keyword for k in r.boost] == ["HubSpot"] and r.terms == ["sales"]
    again = P.revert(after, entry.withColumn("reverted", F.lit(True))).collect()[0]
    assert again.removed == 0 and again.refused == "already reverted"


def test_change_text_none(spark):
    df = spark.createDataFrame([([], [], [])], f"b {KW}, p {KW}, t array<string>")
    assert df.select(P.change_text("b", "p", "t").alias("x")).first().x == "no new items"


def test_no_break_space_and_line_ends(spark):
    from rankloom.functions.text import first_word, strip_quoted
    df = spark.createDataFrame([("\u00a0yes\u00a0please",), ("> a\u2028no\x0b> b",), ("\u3000 ",)], "t string")
    assert [r.w for r in df.select(first_word(strip_quoted("t")).alias("w")).collect()] == ["yes", "no", ""]


def test_badges_capitalise_after_any_non_letter(spark):
    from rankloom.operators.render import badge_text
    df = spark.createDataFrame([("full-time/contract",), ("PART_time",), ("",)], "t string")
    assert [r.b for r in df.select(badge_text("t").alias("b")).collect()] == ["Full-Time/Contract", "Part Time", ""]


def test_every_failed_call_is_retried(spark):
    from rankloom.operators.scoring import retryable
    df = spark.createDataFrame([("200",), ("400",), ("500",), ("transport",), (None,)], "s string")
    assert [r.r for r in df.select(retryable("s").alias("r")).collect()] == [False, True, True, True, None]


def test_reverted_entries_stay_reverted_and_texts_leave_empty_lists_out(spark):
    from rankloom.operators import proposals as P
    kw = "array<struct<keyword:string,weight:double>>"
    prof = spark.createDataFrame([(1, ([("a", 1.0)], []), (["t"],))],
                                 f"profile_id long, scoring struct<boost:{kw},penalize:{kw}>, search struct<terms:array<string>>")
    entry = spark.createDataFrame([(1, 1, [("A", 1.0)], [], [], True)],
                                  f"profile_id long, entry_id int, boost_added {kw}, penalize_added {kw}, terms_added array<string>, reverted boolean")
    r = P.revert(prof, entry).first()
    assert (r.reverted, r.removed, r.refused) == (True, 0, "already reverted")
    df = spark.createDataFrame([("s", [("k", 1.0)], [], None), ("s", [], None, [])], f"s string, b {kw}, p {kw}, t array<string>")
    texts = [r.x for r in df.select(P.proposal_text("s", "b", "p", "t").alias("x")).collect()]
    assert "Boost: k" in texts[0] and "Penalize" not in texts[0] and "Nothing to change" in texts[1]


def test_relevance_on_a_tiny_corpus_and_lossless_bar(spark):
    from rankloom.operators import relevance as R
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(
        ["red fox runs", "red hen sits", "blue fox sits", "red red sea", "green"])], "d long, t string")
    q = spark.createDataFrame([(1, "red fox sits"), (2, "green sea sea")], "q long, t string")
    full = {(r.q, r.d): r.score for r in R.relevance(spark, q, "q", "t", docs, "d", "t", evidence=True, min_score=0).collect()}
    assert full[(1, 0)] > 0 and full[(2, 4)] > 0
    for bar in (1, 30, 60, 100):
        got = {(r.q, r.d): r.score for r in R.relevance(spark, q, "q", "t", docs, "d", "t", evidence=True, min_score=bar).collect()}
        assert got == {k: s for k, s in full.items() if s >= bar}
    some = R.relevance(spark, q, "q", "t", docs, "d", "t", evidence=True, min_score=0, only=docs.filter("d < 2"))
    assert {(r.q, r.d): r.score for r in some.collect()} == {k: s for k, s in full.items() if k[1] < 2}


def test_profile_defaults_keep_null_and_empty_apart(spark, tmp_path):
    from rankloom.operators import profiles as PR
    ids = spark.createDataFrame([(1,), (2,)], "profile_id long")
    new = PR.new_profiles(ids)
    PR.write_profiles(new, f"{tmp_path}/p")
    rows = PR.read_profiles(spark, f"{tmp_path}/p").collect()
    assert {r.profile_id for r in rows} == {1, 2}
    assert rows[0].search.allowed_regions is None and rows[0].search.require_language is None
    assert rows[0].search.terms == [] and rows[0].search.locations == ["Toronto, ON"]
    n = rows[0].notification
    assert (n.max_jobs_per_email, n.max_job_age_days, n.rerank_candidates, n.rerank_min_score) == (10, 7, 30, 0.3)
    part = spark.createDataFrame([{"profile_id": 3, "search": {"allowed_regions": [], "locations": []},
                                   "notification": {"rerank_min_score": 0.35}}], PR.SCHEMA)
    r = PR.with_defaults(part).first()
    assert r.search.allowed_regions == [] and r.search.locations == [] and r.search.hours_old == 24
    assert r.notification.rerank_min_score == 0.35 and r.notification.score_threshold == 60 and r.scoring.boost == []
