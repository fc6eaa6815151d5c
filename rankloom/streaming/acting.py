"""K3, acting: replies change profiles, proposals, history and the outbox.

The state is four tables that are changed batch by batch; a batch reads what the
batches below it left and writes under its own number, so a replay after a
failure at any point writes the same rows again: nothing is applied or mailed
twice, nothing is lost. Messages are keyed by what caused them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import proposals as P
from rankloom.session import materialize
from rankloom.sources.state import StateTable

KEYWORDS = "array<struct<keyword:string,weight:double>>"
ADDED = f"boost_added {KEYWORDS}, penalize_added {KEYWORDS}, terms_added array<string>"
PROFILE = f"profile_id bigint, recipient string, scoring struct<boost:{KEYWORDS},penalize:{KEYWORDS}>, search struct<terms:array<string>>"
PROPOSAL = (f"proposal_id bigint, profile_id bigint, message_id string, status string, summary string, boost_add {KEYWORDS}, "
            f"penalize_add {KEYWORDS}, terms_add array<string>, conversation array<struct<role:string,content:string>>")
HISTORY = f"profile_id bigint, entry_id bigint, applied_at timestamp, {ADDED}, reverted boolean"
OUTBOX = ("message_key string, profile_id bigint, kind string, recipient string, in_reply_to string, subject string, "
          "text string, html string, batch bigint")
CONFIRMED = {"apply": "applied", "discard": "discarded"}


@dataclass
class Desk:
    """The tables that replies act on."""

    profiles: StateTable
    proposals: StateTable
    history: StateTable
    outbox: StateTable

    def active(self, before: int | None = None) -> DataFrame:
        """Pending proposals."""
        return self.proposals.read(before).where("status = 'pending'")


def open_desk(spark: SparkSession, root: str, compact_every: int = 10) -> Desk:
    at = lambda name, keys, schema: StateTable(spark, os.path.join(root, name), keys, schema, compact_every)
    return Desk(at("profiles", ["profile_id"], PROFILE), at("proposals", ["proposal_id"], PROPOSAL),
                at("history", ["profile_id", "entry_id"], HISTORY), at("outbox", ["message_key"], OUTBOX))


def messages(rows: DataFrame, kind, batch: int) -> DataFrame:
    """Outbox rows from ``profile_id, proposal_id, recipient, in_reply_to, subject, text``:
    plain text and the same as HTML. The key names proposal, batch and kind."""
    html = F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(F.replace(
        F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
        F.lit("\n"), F.lit("<br>")), F.lit("</p>"))
    return rows.select(F.concat_ws("/", F.col("proposal_id").cast("string"), F.lit(str(batch)), kind).alias("message_key"), "profile_id",
                       kind.alias("kind"), "recipient", "in_reply_to", "subject", "text", html.alias("html"), F.lit(batch).alias("batch"))


def propose(desk: Desk, new: DataFrame, batch: int) -> None:
    """Save proposals (a profile's earlier pending one is replaced) and mail them."""
    new = materialize(new, "new-proposals")
    old = desk.active(batch).join(new.select("profile_id", F.col("proposal_id").alias("by")), "profile_id").where("proposal_id <> by")
    desk.proposals.put(new.unionByName(old.drop("by").withColumn("status", F.lit("replaced"))), batch)
    mail = new.join(desk.profiles.read().select("profile_id", "recipient"), "profile_id").select(
        "profile_id", "proposal_id", "recipient", F.lit(None).cast("string").alias("in_reply_to"),
        F.lit("Suggested profile changes").alias("subject"),
        P.proposal_text("summary", "boost_add", "penalize_add", "terms_add").alias("text"))
    desk.outbox.put(messages(mail, F.lit("proposal"), batch), batch)


def act(desk: Desk, actions: DataFrame, batch: int, at: str) -> None:
    """``actions(proposal_id, action, reply, reply_id)``, one per proposal, on the
    proposals that are pending: apply changes the profile and enters the history,
    discard closes the proposal, revise edits its lists by the reply and mails it
    again. Each action gives one message, in reply to the mail acted on."""
    open_ = desk.active(batch).join(actions, "proposal_id")
    people = desk.profiles.read(batch)
    x = materialize(open_.join(people.select("profile_id", "recipient"), "profile_id"), "acted")
    applied = materialize(P.apply(people, x.where("action = 'apply'").drop("recipient")), "applied")
    revised = materialize(P.revise_lists(x.where("action = 'revise'"), "reply"), "revised")
    cols = [f.name for f in desk.proposals.schema.fields]
    closed = x.where(F.col("action").isin(*CONFIRMED)).withColumn("status", F.when(F.col("action") == "apply", "applied").otherwise("discarded"))
    desk.profiles.put(applied, batch)
    desk.history.put(applied.select("profile_id", F.col("proposal_id").alias("entry_id"), F.lit(at).cast("timestamp").alias("applied_at"),
                                    "boost_added", "penalize_added", "terms_added", F.lit(False).alias("reverted")), batch)
    desk.proposals.put(closed.select(*cols).unionByName(revised.select(*cols)), batch)
    told = ["profile_id", "proposal_id", "recipient", F.col("reply_id").alias("in_reply_to")]
    done = applied.select(*told, F.lit("Profile updated").alias("subject"), F.concat(F.lit("Applied: "), F.col("change_text")).alias("text"),
                          F.lit("applied").alias("kind"))
    dropped = x.where("action = 'discard'").select(*told, F.lit("Proposal discarded").alias("subject"),
                                                   F.lit("Nothing was changed.").alias("text"), F.lit("discarded").alias("kind"))
    again = revised.select(*told, F.lit("Suggested profile changes, revised").alias("subject"),
                           P.proposal_text("summary", "boost_add", "penalize_add", "terms_add").alias("text"), F.lit("revised").alias("kind"))
    desk.outbox.put(messages(done.unionByName(dropped).unionByName(again), F.col("kind"), batch), batch)


def revert(desk: Desk, requests: DataFrame, batch: int) -> DataFrame:
    """``requests(request_id, profile_id, position)`` against the history, newest
    first: the items an entry added leave the profile and the entry is marked.
    Returns the outcome of each request (B16). Several entries of one profile are
    taken back together."""
    entries = desk.history.read(batch)
    outcome = materialize(P.revert_requests(entries, requests), "revert-outcomes")
    due = entries.join(outcome.where("outcome = 'reverted'").select("profile_id", "entry_id"), ["profile_id", "entry_id"], "left_semi")
    desk.history.put(due.withColumn("reverted", F.lit(True)), batch)
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array()))).alias(c)  # noqa: E731  one profile's reverted entries
    gone = due.groupBy("profile_id").agg(F.min("entry_id").alias("entry_id"), flat("boost_added"), flat("penalize_added"), flat("terms_added"),
                                         F.lit(False).alias("reverted"))
    back = P.revert(desk.profiles.read(batch).select("profile_id", "scoring", "search"), gone)
    kept = desk.profiles.read(batch).join(back.select("profile_id", "boost", "penalize", "terms"), "profile_id")
    desk.profiles.put(kept.select("profile_id", "recipient", F.struct("boost", "penalize").alias("scoring"),
                                  F.struct("terms").alias("search")), batch)
    return outcome
