"""Replies that act: profile, proposal, history and outbox over batches, with a replay."""

from rankloom.streaming import acting as ACT
from rankloom.streaming import streams as ST

AT = "2024-01-31 18:00:00"


def desk_of(spark):
    desk = ACT.open_desk(spark, ST.run_dir(spark, "desk-test"), compact_every=2)
    people = [(k, f"user{k}@example.org", ([("gear", 5.0)], []), (["driver"],)) for k in (1, 2, 3)]
    desk.profiles.put(spark.createDataFrame(people, ACT.PROFILE), 0)
    ACT.propose(desk, spark.createDataFrame([proposal(k, k) for k in (1, 2, 3)], ACT.PROPOSAL), 0)
    return desk


def proposal(number, profile, boost=(("Gear", 9.0), ("bolt", 7.0))):
    return (number, profile, f"<p{number}>", "pending", "Because", list(boost), [("plate", -20.0)], ["fitter"], [])


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), "proposal_id long, action string, reply string, reply_id string")


def profile(desk, k):
    r = desk.profiles.read().where(f"profile_id = {k}").first()
    return [x.keyword for x in r.scoring.boost], [x.keyword for x in r.scoring.penalize], list(r.search.terms)


def status(desk):
    return {r.proposal_id: r.status for r in desk.proposals.read().collect()}


def test_replies_change_profiles_and_mail_once(spark):
    desk = desk_of(spark)
    first = actions(spark, (1, "apply", "yes", "<r1>"), (2, "discard", "no", "<r2>"),
                    (3, "revise", "Boost welding 99\npenalize  night shift -5\ndrop BOLT\nadd pipe fitter\nthanks", "<r3>"))
    for _ in range(2):  # the batch is replayed: everything stays as it was
        ACT.act(desk, first, 1, AT)
        assert profile(desk, 1) == (["gear", "bolt"], ["plate"], ["driver", "fitter"])
        assert profile(desk, 2) == profile(desk, 3) == (["gear"], [], ["driver"])
        assert status(desk) == {1: "applied", 2: "discarded", 3: "pending"}
    third = desk.proposals.read().where("proposal_id = 3").first()
    assert [(k.keyword, k.weight) for k in third.boost_add] == [("Gear", 9.0), ("welding", 20.0)]
    assert [(k.keyword, k.weight) for k in third.penalize_add] == [("plate", -20.0), ("night shift", -10.0)]
    assert third.terms_add == ["fitter", "pipe fitter"] and third.conversation[-1].content.startswith("Boost welding")
    ACT.act(desk, actions(spark, (1, "apply", "yes", "<r4>"), (3, "apply", "ok", "<r5>")), 2, AT)  # 1 is closed
    assert profile(desk, 3) == (["gear", "welding"], ["plate", "night shift"], ["driver", "fitter", "pipe fitter"])
    mails = sorted((r.message_key, r.recipient, r.in_reply_to) for r in desk.outbox.read().collect())
    assert mails == [("1/0/proposal", "user1@example.org", None), ("1/1/applied", "user1@example.org", "<r1>"),
                     ("2/0/proposal", "user2@example.org", None), ("2/1/discarded", "user2@example.org", "<r2>"),
                     ("3/0/proposal", "user3@example.org", None), ("3/1/revised", "user3@example.org", "<r3>"),
                     ("3/2/applied", "user3@example.org", "<r5>")]
    text = desk.outbox.read().where("message_key = '1/1/applied'").first()
    assert text.text == "Applied: 1 boost keyword(s), 1 penalize keyword(s), 1 search term(s)" and text.html.startswith("<p>Applied")


def test_revert_takes_back_what_was_added(spark):
    desk = desk_of(spark)
    ACT.act(desk, actions(spark, (1, "apply", "yes", "<r1>")), 1, AT)
    asked = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 2, 0)], "request_id long, profile_id long, position long")
    for _ in range(2):
        got = {r.request_id: r.outcome for r in ACT.revert(desk, asked, 2).collect()}
        assert got == {1: "reverted", 2: "already reverted", 3: "not found"}
        assert profile(desk, 1) == (["gear"], [], ["driver"]) and desk.history.read().first().reverted
    later = {r.request_id: r.outcome for r in ACT.revert(desk, asked, 3).collect()}
    assert later[1] == "already reverted" and profile(desk, 1) == (["gear"], [], ["driver"])


def test_a_new_proposal_replaces_the_pending_one(spark):
    desk = desk_of(spark)
    ACT.propose(desk, spark.createDataFrame([proposal(9, 1)], ACT.PROPOSAL), 1)
    assert status(desk) == {1: "replaced", 2: "pending", 3: "pending", 9: "pending"}
    ACT.act(desk, actions(spark, (1, "apply", "yes", "<late>")), 2, AT)
    assert profile(desk, 1) == (["gear"], [], ["driver"])
