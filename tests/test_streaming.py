"""Streams: equal to their batch queries however the table is cut into files;
the digest ledger keeps every day (K4); replies act on what they say (K3)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from rankloom.sources.listings import BOARD_PROFILE_ID
from rankloom.streaming import streams as ST


def test_digest_days_add_up_and_reruns_add_nothing(spark):
    ledger = ST.run_dir(spark, "ledger-test")
    days = ("2024-01-30 18:00:00", "2024-01-31 18:00:00")
    first = {r.job_url for r in ST.digest_stream(spark, SMALL, days[0], ledger).collect()}
    both = ST.digest_stream(spark, SMALL, days[1], ledger).collect()
    assert {r.job_url for r in both if str(r.sent_at) == days[0]} == first
    assert len({r.job_url for r in both}) == len(both) > len(first) > 0
    again = ST.digest_stream(spark, SMALL, days[0], ledger).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, both))


@pytest.fixture(scope="module")
def cut_tables(spark, tmp_path_factory):
    """The streamed tables as folders of four files."""
    root = str(tmp_path_factory.mktemp("cut"))
    for name in ("documents", "events", "conversations", "region", "labels", "nation"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        df.repartition(4).write.parquet(f"{root}/{name}.parquet")
    return root


def rows(df):
    return sorted(map(str, df.collect()))


def test_streams_read_folders_file_by_file(spark, cut_tables):
    q = E.queries()
    assert rows(ST.feedback_stream(spark, cut_tables, 1)) == rows(ST.feedback_stream(spark, SMALL))
    assert rows(ST.activity_stream(spark, cut_tables, max_files=1)) == rows(ST.activity_stream(spark, SMALL))
    assert rows(ST.insights_stream(spark, cut_tables, 1)) == rows(q["stream_insights"](spark, SMALL))
    assert rows(ST.ingest_stream(spark, cut_tables)) == rows(ST.ingest_stream(spark, SMALL))
    urls = lambda df: sorted(r.job_url for r in df.collect())  # noqa: E731  which copy comes first follows the files
    assert urls(ST.ingest_stream(spark, cut_tables, max_files=1)) == urls(ST.ingest_stream(spark, SMALL))
    assert rows(ST.replies_stream(spark, cut_tables)) == rows(ST.replies_stream(spark, SMALL))


def test_quoted_reject_discards(spark):
    proposals = spark.createDataFrame([(k, f"<{k}>") for k in range(4)], "proposal_id long, message_id string")
    said = ["> Proposal: reply yes\n\nreject", "> go ahead?\nyes\u00a0please", "\u00a0No.", "ok?"]
    replies = spark.createDataFrame([(k, f"<{k}>", [], False, t) for k, t in enumerate(said)],
                                    "uid long, in_reply_to string, references array<string>, seen boolean, body string")
    got = {r.proposal_id: r.action for r in ST.reply_actions(replies, proposals).collect()}
    assert got == {0: "discard", 1: "apply", 2: "discard", 3: "apply"}


def test_decided_proposals_stay_decided(spark, cut_tables):
    final = ST.replies_stream(spark, cut_tables, 1)
    assert final.count() == ST.replies_stream(spark, SMALL).count()
    assert final.filter(F.col("state").isNull()).count() == 0 and BOARD_PROFILE_ID == 0


def test_schema_parity_of_batch_and_stream_fold(spark):
    q = E.queries()
    a = q["feedback_state"](spark, SMALL)
    b = q["stream_feedback"](spark, SMALL)
    assert set(a.columns) == set(b.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_activity_windows_batch(spark):
    from datetime import datetime
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 10, 0)), (1, datetime(2024, 1, 1, 10, 20)),
                                (1, datetime(2024, 1, 1, 12, 0)), (2, datetime(2024, 1, 1, 10, 5))],
                               "user long, ts timestamp")
    sessions = ST.activity_counts(ev, ["user"], kind="session", gap="30 minutes")
    assert sorted((r.user, r.n) for r in sessions.collect()) == [(1, 1), (1, 2), (2, 1)]
    days = ST.activity_counts(ev, ["user"], kind="tumbling", size="1 day")
    assert sorted((r.user, r.n) for r in days.collect()) == [(1, 3), (2, 1)]
    sliding = ST.activity_counts(ev, [], kind="sliding", size="2 hours", slide="1 hour")
    assert sum(r.n for r in sliding.collect()) == 8  # every event falls in two windows
