"""Digest mails: a failure between any two writes sends nothing twice and loses nothing."""

import pytest
from pyspark.sql import functions as F

from rankloom.streaming import dispatch as DP
from rankloom.streaming import streams as ST

DAYS = ("2024-01-30 18:00:00", "2024-01-31 18:00:00", "2024-02-01 18:00:00")
NOTE = "notification struct<timezone:string,email_subject:string,telegram_message:string>"


@pytest.fixture(scope="module")
def people(spark):
    note = ("UTC", "{count} new, best {top_score}", "{count}")
    return spark.createDataFrame([(1, "one@example.org", note), (2, "two@example.org", note), (3, None, note)],
                                 f"profile_id long, recipient string, {NOTE}")


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(p, f"u{p}-{k}", 90 - k, f"Title {k} <b>", None if k == 1 else "Firm", "Here", False, "full_time", "2024-01-29") for p in (1, 2, 3) for k in range(5)]
    return spark.createDataFrame(rows, "profile_id long, job_url string, score int, title string, company string, location string, "
                                       "is_remote boolean, job_type string, date_posted string")


def chooser(jobs):
    """The two best of each profile that were not sent."""
    def choose(sent):
        from rankloom.operators.digest import top_by_score
        return top_by_score(jobs.join(sent.select("profile_id", "job_url"), ["profile_id", "job_url"], "left_anti"), 2)
    return choose


def mails(box):
    return {r.message_key: (r.recipient, r.subject, r.text) for r in box.outbox.read().collect()}


def ledger(box):
    return sorted((r.profile_id, r.job_url, r.batch) for r in box.ledger.read().collect())


def whole(spark, jobs, people):
    box = DP.open_mailer(spark, ST.run_dir(spark, "mailer"), compact_every=2)
    for batch, day in enumerate(DAYS):
        DP.send_digest(box, batch, day, chooser(jobs), people)
    return mails(box), ledger(box)


@pytest.fixture(scope="module")
def undisturbed(spark, jobs, people):
    return whole(spark, jobs, people)


def test_three_days(undisturbed):
    sent, marked = undisturbed
    assert sorted(sent) == sorted(f"{p}/{day[:10]}/{b}" for b, day in enumerate(DAYS) for p in (1, 2))
    assert sent["1/2024-01-30/0"] == ("one@example.org", "2 new, best 90", "1. Title 0 <b> at Firm (Here), 90/100, u1-0\n2. Title 1 <b> at  (Here), 89/100, u1-1")
    assert sent["2/2024-02-01/2"][1] == "1 new, best 86"
    # the profile without an address has no mail and keeps its listings unmarked
    assert marked == [(p, f"u{p}-{k}", k // 2) for p in (1, 2) for k in range(5)]


@pytest.mark.parametrize("broken", ["outbox", "ledger"])
@pytest.mark.parametrize("replayed", [True, False])
def test_a_failure_between_the_writes(spark, jobs, people, undisturbed, monkeypatch, broken, replayed):
    """The second day's batch fails at a write; it is run again, or the third day comes first."""
    box = DP.open_mailer(spark, ST.run_dir(spark, "mailer"), compact_every=2)
    DP.send_digest(box, 0, DAYS[0], chooser(jobs), people)
    with monkeypatch.context() as m:
        def fail(*_):
            raise OSError("lost")
        m.setattr(getattr(box, broken), "put", fail)
        with pytest.raises(OSError):
            DP.send_digest(box, 1, DAYS[1], chooser(jobs), people)
    if replayed:  # with other listings by now: the choice stands
        DP.send_digest(box, 1, DAYS[1], chooser(jobs.withColumn("score", 200 - F.col("score"))), people)
    DP.send_digest(box, 2, DAYS[2], chooser(jobs), people)
    assert (mails(box), ledger(box)) == undisturbed
    DP.send_digest(box, 2, DAYS[2], chooser(jobs), people)
    assert (mails(box), ledger(box)) == undisturbed


def test_delivery_hands_over_what_has_no_receipt(spark, jobs, people):
    box, seen = DP.open_mailer(spark, ST.run_dir(spark, "mailer")), []
    DP.send_digest(box, 0, DAYS[0], chooser(jobs), people)

    def first_only(messages):
        seen.append(sorted(r.message_key for r in messages.collect()))
        return messages.where("profile_id = 1")

    DP.deliver(box, 0, first_only)
    DP.send_digest(box, 1, DAYS[1], chooser(jobs), people)
    DP.deliver(box, 1, lambda m: (seen.append(sorted(r.message_key for r in m.collect())), m)[1])
    assert seen == [["1/2024-01-30/0", "2/2024-01-30/0"], ["1/2024-01-31/1", "2/2024-01-30/0", "2/2024-01-31/1"]]
    assert box.unsent().count() == 0


def test_a_day_without_listings_or_people(spark, jobs, people):
    box = DP.open_mailer(spark, ST.run_dir(spark, "mailer"))
    DP.send_digest(box, 0, DAYS[0], lambda sent: chooser(jobs)(sent).limit(0), people)
    DP.send_digest(box, 1, DAYS[1], chooser(jobs), people.limit(0))
    assert mails(box) == {} and ledger(box) == []
