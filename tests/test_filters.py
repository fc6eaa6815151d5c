"""Pre-filters, freshness and keyword weights: the reference's unit cases as rows."""

from datetime import datetime, timedelta

import pytest

from rankloom.operators import digest as D
from rankloom.operators import filters as B
from rankloom.operators import scoring as S

REGION_CASES = [
    ("Gmunden, Oberland, Austria", False, ["Oberland", "Linz"], True),
    ("Linz, OB, AT", False, ["Linz", "Oberland"], True),
    ("Porto, PT", True, ["Oberland", "Linz"], True),
    ("Porto, Douro Litoral, Portugal", False, ["Oberland", "Linz"], False),
    ("Sainte-Élodie, BE", False, ["Oberland", "Linz"], False),
    ("Porto, PT", False, None, True),
    ("Porto, PT", False, [], True),
    ("linz, ob, at", False, ["Linz"], True),
]


def test_region_filter(spark):
    df = spark.createDataFrame(REGION_CASES, "location string, is_remote boolean, regions array<string>, expected boolean")
    got = df.select(B.region_ok("location", "is_remote", "regions").alias("ok"), "expected").collect()
    assert [r.ok for r in got] == [r.expected for r in got]


LANGUAGE_CASES = [
    ("Boulanger de nuit", None, None, True),
    ("Boulangère·er de nuit", "", None, True),
    ("Night baker", "en", "en", True),
    ("Boulanger de quartier", "en", "fr", False),
    ("zzz", "en", None, True),  # detector failure passes
]


def test_language_filter(spark):
    df = spark.createDataFrame(LANGUAGE_CASES, "text string, req string, detected string, expected boolean")
    got = df.select(B.language_ok("detected", "req").alias("ok"), "expected").collect()
    assert [r.ok for r in got] == [r.expected for r in got]


SCORING = {"boost": [("Sourdough", 16.0), ("oven", 11.0), ("night shift", 20.0)],
           "penalize": [("unpaid", -50.0), ("driving", -35.0), ("freezer", -25.0)]}

BOOST_CASES = [
    (60.0, "Sourdough, oven and night shift work.", True, 80.0),
    (70.0, "An unpaid week with driving.", True, 50.0),
    (70.0, "Unpaid freezer duty and driving.", True, 50.0),
    (95.0, "Sourdough oven night shift.", True, 100.0),
    (5.0, "Unpaid freezer driving.", True, 0.0),
    (45.0, "Tax office with a view of the lake.", True, 45.0),
    (72.0, "Any text", False, 72.0),
    (60.0, "", True, 60.0),
]


def test_keyword_delta_cases(spark):
    kw = "array<struct<keyword:string,weight:double>>"
    rows = [(raw, d, [list(x) for x in SCORING["boost"]] if on else [], [list(x) for x in SCORING["penalize"]] if on else [],
             exp) for raw, d, on, exp in BOOST_CASES]
    df = spark.createDataFrame(rows, f"raw double, d string, boost {kw}, pen {kw}, expected double")
    got = df.select(S.adjust("raw", S.keyword_delta("d", "boost", "pen")).alias("adj"), "expected").collect()
    assert [r.adj for r in got] == [r.expected for r in got]


def test_keyword_delta_single_and_case(spark):
    kw = "array<struct<keyword:string,weight:double>>"
    b = [list(x) for x in SCORING["boost"]]
    p = [list(x) for x in SCORING["penalize"]]
    df = spark.createDataFrame([(60.0, "You knead Sourdough all day.", b, p),
                                (60.0, "SOURDOUGH and OVEN skills.", b, p)],
                               f"raw double, d string, boost {kw}, pen {kw}")
    got = [r.adj for r in df.select(S.adjust("raw", S.keyword_delta("d", "boost", "pen")).alias("adj")).collect()]
    assert all(60.0 < x <= 80.0 for x in got)


def test_boost_reason_half_even(spark):
    df = spark.createDataFrame([("r", 60, 80.0), ("r", 70, 50.0), ("r", 45, 45.0), ("r", 10, 12.5), ("r", 10, 13.5)],
                               "reason string, raw int, adj double")
    got = [r.x for r in df.select(S.boost_reason("reason", "raw", "adj").alias("x")).collect()]
    assert got == ["r [+20pts entity boost]", "r [-20pts entity boost]", "r", "r [+2pts entity boost]",
                   "r [+4pts entity boost]"]


AS_OF = "2024-01-30 18:00:00"


def _d(days):
    return (datetime.fromisoformat(AS_OF) - timedelta(days=days)).date().isoformat()


def _ts(days):
    return datetime.fromisoformat(AS_OF) - timedelta(days=days)


FRESH_CASES = [  # date_posted, discovered_at, rating, sent, expected rows
    (_d(5), _ts(1), None, False, 1),
    (_d(20), _ts(1), None, False, 0),
    ("nan", _ts(2), None, False, 1),
    ("nan", _ts(10), None, False, 0),
    ("", _ts(1), None, False, 1),
    (_d(5) + "T10:00:00", _ts(1), None, False, 1),
    (_d(20) + "T10:00:00", _ts(1), None, False, 0),
    (_d(1), _ts(1), -1, False, 0),
    (_d(1), _ts(1), None, True, 0),
]


@pytest.mark.parametrize("case", range(len(FRESH_CASES)))
def test_freshness_cases(spark, case):
    dp, disc, rating, sent, expected = FRESH_CASES[case]
    jobs = spark.createDataFrame([(0, "https://x/1", 80, dp, disc, rating, False)],
                                 "profile_id long, job_url string, score int, date_posted string, "
                                 "discovered_at timestamp, user_rating int, hidden boolean")
    ledger = spark.createDataFrame([(0, "https://x/1", _ts(3))] if sent else [],
                                   "profile_id long, job_url string, sent_at timestamp")
    got = D.candidates(D.with_settings(jobs), ledger, AS_OF).count()
    assert got == expected


def test_fallback_cutoff_day_passes_in_parity(spark):
    # discovered 7 days and 10 hours before: same calendar day as the cutoff
    jobs = spark.createDataFrame([(0, "u", 80, None, _ts(7) - timedelta(hours=10), None, None)],
                                 "profile_id long, job_url string, score int, date_posted string, "
                                 "discovered_at timestamp, user_rating int, hidden boolean")
    empty = spark.createDataFrame([], "profile_id long, job_url string, sent_at timestamp")
    assert D.candidates(D.with_settings(jobs), empty, AS_OF, parity=True).count() == 1
    assert D.candidates(D.with_settings(jobs), empty, AS_OF, parity=False).count() == 0


def test_history_search_keeps_wildcards_and_escapes_backslash(spark):
    df = spark.createDataFrame([("50% off", "a"), ("5x off", "b"), ("back\\slash", "c")], "title string, employer string")
    assert df.filter(B.text_search("50%", "title", "employer")).count() == 1
    assert df.filter(B.text_search("5_", "title", "employer")).count() == 2
    assert df.filter(B.text_search("k\\s", "title", "employer")).count() == 1
