"""Digest mails that are sent once: choose, put into the outbox, then mark as sent.

A batch is one digest of one day for all profiles. It changes two tables, the
outbox and the ledger, and may break off anywhere:

1. the listings chosen for every profile are written to a folder of the batch;
2. the messages made of these rows go into the outbox, keyed by profile, day
   and batch;
3. their URLs go into the ledger.

Steps 2 and 3 read step 1's folder and nothing that they change themselves, so
doing them again writes the same rows. A batch that finds its choice finished
takes it as it is; later batches first complete what an earlier one left half
done. So a listing is in the ledger if and only if it is in a message (once both
are complete), no message is made twice, and none is lost.

What a transport has taken is a third table: ``deliver`` hands over messages
without a receipt, by their keys, and stores the keys that it reports.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import render as R
from rankloom.session import materialize
from rankloom.sources.state import StateTable
from rankloom.sources.tables import finished
from rankloom.streaming.acting import OUTBOX

LEDGER = "profile_id bigint, job_url string, sent_at timestamp, batch bigint"
RECEIPTS = "message_key string, batch bigint"
CARD = ("profile_id", "pos", "job_url", "score", "title", "company", "location", "is_remote", "job_type", "date_posted")


@dataclass
class Mailer:
    spark: SparkSession
    root: str
    outbox: StateTable
    ledger: StateTable
    receipts: StateTable

    def choice(self, batch: int) -> str:
        return os.path.join(self.root, "chosen", f"batch={batch}")

    def unsent(self, before: int | None = None) -> DataFrame:
        """Messages that no transport has taken yet."""
        return self.outbox.read(before).join(self.receipts.read().select("message_key"), "message_key", "left_anti")


def open_mailer(spark: SparkSession, root: str, compact_every: int = 10) -> Mailer:
    at = lambda name, keys, schema: StateTable(spark, os.path.join(root, name), keys, schema, compact_every)
    return Mailer(spark, root, at("outbox", ["message_key"], OUTBOX), at("ledger", ["profile_id", "job_url"], LEDGER),
                  at("receipts", ["message_key"], RECEIPTS))


def plain_text(top: DataFrame) -> DataFrame:
    """``profile_id, text``: a digest as lines, in its order. A profile's digest is
    already cut to ``max_jobs_per_email`` rows."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), c("title"), F.lit(" at "), c("company"), F.lit(" ("), c("location"), F.lit("), "),
                    F.col("score").cast("string"), F.lit("/100, "), F.col("job_url"))
    lines = top.select("profile_id", F.struct("pos", line.alias("line")).alias("l")).groupBy("profile_id").agg(F.collect_list("l").alias("ls"))
    return lines.select("profile_id", F.array_join(F.transform(F.array_sort("ls"), lambda x: x["line"]), "\n").alias("text"))


def digest_mail(top: DataFrame, profiles: DataFrame, batch: int, as_of: str) -> DataFrame:
    """Outbox rows: subject and HTML by the profile's templates (D7, H14-H18), plain
    text, and the profile's ``recipient``; a profile without one gets no mail."""
    page = R.digest_messages(top, profiles, as_of).select("profile_id", "subject", "html")
    who = profiles.where(F.col("recipient").isNotNull()).select("profile_id", "recipient")
    return page.join(plain_text(top), "profile_id").join(who, "profile_id").select(
        F.concat_ws("/", F.col("profile_id").cast("string"), F.lit(as_of[:10]), F.lit(str(batch))).alias("message_key"), "profile_id",
        F.lit("digest").alias("kind"), "recipient", F.lit(None).cast("string").alias("in_reply_to"), "subject", "text", "html",
        F.lit(batch).cast("bigint").alias("batch"))


def send_digest(box: Mailer, batch: int, as_of: str, choose: Callable[[DataFrame], DataFrame], profiles: DataFrame) -> None:
    """One digest batch; batches are numbered 0 and up. ``choose(sent)`` gives the
    rows to send (``CARD`` columns, ranked and cut) from the ledger's rows that
    earlier batches left. A repeated batch changes nothing."""
    for left in range(batch):  # a finished choice whose ledger rows are missing
        if finished(box.spark, box.choice(left)) and not _complete(box, left):
            _send(box, left, profiles)
    if not finished(box.spark, box.choice(batch)):
        who = profiles.where(F.col("recipient").isNotNull()).select("profile_id")
        rows = choose(box.ledger.read(batch)).select(*CARD).join(who, "profile_id", "left_semi")
        rows.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").parquet(box.choice(batch))
    if not _complete(box, batch):
        _send(box, batch, profiles)


def _complete(box: Mailer, batch: int) -> bool:
    return finished(box.spark, os.path.join(box.root, "done", f"batch={batch}"))


def _send(box: Mailer, batch: int, profiles: DataFrame) -> None:
    chosen = box.spark.read.parquet(box.choice(batch))
    day = chosen.select("as_of").first()
    if day is not None:
        box.outbox.put(digest_mail(chosen, profiles, batch, day[0]), batch)
        box.ledger.put(chosen.select("profile_id", "job_url", F.col("as_of").cast("timestamp").alias("sent_at"), F.lit(batch).alias("batch")), batch)
    box.spark.range(0).write.mode("overwrite").parquet(os.path.join(box.root, "done", f"batch={batch}"))


def deliver(box: Mailer, batch: int, transport: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hand the messages without a receipt to ``transport``, which returns the
    ``message_key`` of those it took (a DataFrame), and store these receipts. A
    transport that was asked for a key twice, because the receipt was lost, must
    take it as the same message."""
    todo = materialize(box.unsent(), "unsent")
    took = materialize(transport(todo).select("message_key").distinct(), "taken")
    box.receipts.put(took.join(todo.select("message_key"), "message_key", "left_semi").withColumn("batch", F.lit(batch)), batch)
    return took
