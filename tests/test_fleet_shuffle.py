"""The fleet's candidates: dealt by order once, looked up in the ledger there, cut per profile by one exchange."""

import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import digest as D
from rankloom.operators.ranking import top_n_per_group
from rankloom.plans import rerank as RQ
from tests.conftest import SMALL

JOBS = "profile_id bigint, job_url string, l_orderkey bigint, score int, date_posted string, discovered_at timestamp"


def fleet(spark):
    rows = [(1 + k % 3, f"https://t.example/{k // 4}/{k % 4}", k // 4, k % 101, "1998-06-01", None) for k in range(60)]
    jobs = spark.createDataFrame(rows + [(None, "https://t.example/0/9", 0, 90, "1998-06-01", None)], JOBS)
    sent = [(p, u, o) for p, u, o, *_ in rows[::5]] + [(p + 1, u, o) for p, u, o, *_ in rows[::7]] + [
        rows[0][:3], (None, "https://t.example/0/1", 0), (1, None, 3)]
    return jobs, spark.createDataFrame(sent, "profile_id bigint, job_url string, l_orderkey bigint")


def test_ledger_by_order_leaves_what_the_plain_ledger_leaves(spark):
    jobs, ledger = fleet(spark)
    plain = D.candidates(D.with_settings(jobs, score_threshold=10), ledger, "1998-06-01 00:00:00")
    near = D.candidates(D.with_settings(D.unsent(jobs, ledger, "l_orderkey"), score_threshold=10), None, "1998-06-01 00:00:00")
    assert near.columns == plain.columns == D.with_settings(jobs).columns
    rows = lambda x: sorted((str(r.profile_id), r.job_url) for r in x.collect())
    assert rows(near) == rows(plain) and 0 < len(rows(near)) < 50


def test_listings_are_not_dealt_by_url_or_salt(spark):
    """Before, every listing went through exchanges by key, (profile, URL) and (profile, salt)."""
    plan = RQ.fleet_cut(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*?), \d+\)", plan)
    assert dealt and not [d for d in dealt if "job_url" in d or "_salt" in d or "l_linenumber" in d]


@pytest.mark.parametrize("most", [None, 7, 4])
def test_cut_by_a_known_largest_limit(spark, most):
    x = spark.range(400).select((F.col("id") % 5).alias("g"), F.col("id").alias("k"), (F.col("id") % 5).cast("int").alias("n"))
    got = top_n_per_group(x, ["g"], [F.col("k").desc()], F.col("n"), most=most).groupBy("g").agg(
        F.collect_set("rank").alias("r"), F.min("k").alias("least")).collect()
    assert {r.g: sorted(r.r) for r in got} == {g: list(range(1, g + 1)) for g in range(1, 5)}
    assert {r.g: r.least for r in got} == {g: 395 + g - 5 * (g - 1) for g in range(1, 5)}


def test_largest_setting_knows_defaults_and_no_profiles(spark):
    notes = "profile_id bigint, notification struct<score_threshold:int,max_jobs_per_email:int,max_job_age_days:int," \
            "rerank_candidates:int,rerank_min_score:double>"
    people = spark.createDataFrame([(1, (60, 3, 7, None, 0.3)), (2, (60, 9, 7, 20, 0.3))], notes)
    assert D.largest(people, "max_jobs_per_email") == 9
    assert D.largest(people, "rerank_candidates") == 30  # the first profile has the default
    assert D.largest(people.limit(0), "max_jobs_per_email") == 0
