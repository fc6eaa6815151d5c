"""The reply inbox as landed mail rows, derived from ``conversations``.

Every user turn after the first is a reply mail to the conversation's
proposal. Header fields vary the way mail clients do: some replies carry
``In-Reply-To``, others only ``References`` (sometimes naming a neighbouring
thread), some were already read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_id(conv: Column) -> Column:
    """Deterministic Message-ID of a conversation's proposal mail."""
    return F.concat(F.lit("<proposal-"), conv.cast("string"), F.lit("@rankloom.local>"))


def replies_from(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, uid, in_reply_to, references, seen, body)``; works on
    batch and streaming ``conversations``."""
    c = conversations.filter((F.col("role") == "user") & (F.col("turn") > 0))
    t = F.col("turn")
    return c.select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + t).alias("uid"),
        F.when(t % 4 == 1, message_id(F.col("conv_id"))).alias("in_reply_to"),
        F.when(t % 4 == 3, F.array(message_id(F.col("conv_id") - 1), message_id(F.col("conv_id"))))
         .otherwise(F.array(message_id(F.col("conv_id") + 1))).alias("references"),
        (t % 5 == 4).alias("seen"), reply_body().alias("body"))


def reply_body() -> Column:
    """What the mail says: some clients quote the proposal above the answer,
    and some users answer in one word."""
    t, conv = F.col("turn"), F.col("conv_id")
    said = F.when(conv % 4 == 0, F.lit("Reject, thanks")).when(conv % 4 == 1, F.lit("yes please")) \
        .when(conv % 4 == 2, F.lit("no")).otherwise(F.col("text"))
    return F.when(t % 2 == 0, F.concat(F.lit("> Proposal\n> reply yes to apply\n\n"), said)).otherwise(said)


def proposals_from(conversations: DataFrame) -> DataFrame:
    """One proposal per conversation, with its Message-ID."""
    return (conversations.select(F.col("conv_id").alias("proposal_id")).distinct()
            .withColumn("message_id", message_id(F.col("proposal_id"))))
