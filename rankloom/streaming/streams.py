"""Structured Streaming forms of the batch jobs (K1-K6).

Sources are file streams over the landed tables (one table per stream, a file
or a folder of files); sinks are parquet folders under the shared
checkpoint folder. Every sink write goes through ``foreachBatch`` keyed by the
micro-batch id, so a replayed batch overwrites its own output instead of
adding to it (exactly-once on top of the checkpointed offsets).

Stateful aggregations run in *update* mode: each micro-batch writes only the
keys it changed, tagged with the batch id, and readers take the latest row per
key. That keeps per-batch output proportional to the change, not to the state.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, LongType, StringType, StructField, StructType, TimestampType

from rankloom.functions.text import strip_quoted
from rankloom.operators import feedback as FB
from rankloom.operators import ingest as I
from rankloom.operators import language as LG
from rankloom.operators import replies as RP
from rankloom.session import materialize, table_dir
from rankloom.sources.inbox import proposals_from, replies_from
from rankloom.sources.listings import board_rows, feedback_log, fetched
from rankloom.sources.state import StateTable
from rankloom.sources.tables import align_to, has_subdirs, read
from rankloom.sources.url_index import UrlIndex
from rankloom.streaming import acting as ACT


INGEST_SINK = StructType(
    [StructField("id", LongType()), StructField("arrival", LongType())]
    + [StructField(c, StringType()) for c in ("job_url", "title", "employer", "location", "description", "date_posted", "job_type")]
    + [StructField("is_remote", BooleanType()), StructField("discovered_at", TimestampType())])
LEDGER = StructType([StructField("profile_id", LongType()), StructField("job_url", StringType()),
                     StructField("sent_at", TimestampType()), StructField("sent_on", DateType())])


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A landed table as a file stream, whether it is one file or a folder of
    files. ``max_files`` bounds a micro-batch; by default one takes all that is there."""
    path = os.path.join(sf_dir, f"{table}.parque[t]")  # as a pattern it may name a file or a folder
    reader = spark.readStream.schema(read(spark, sf_dir, table).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_dir(spark: SparkSession, name: str) -> str:
    return table_dir(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")


def _run(query_writer):
    """Drain what has landed; a failed batch raises here."""
    query_writer.trigger(availableNow=True).start().awaitTermination()


def _batch_writer(out: str, transform):
    """foreachBatch sink: ``transform(batch_df, batch_id)`` then overwrite the
    folder of this batch id (idempotent on replay)."""
    def write(df: DataFrame, batch_id: int):
        res = transform(df, batch_id)
        if res is not None:
            res.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))
    return write


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Read an update-mode sink: the row of the highest batch id per key."""
    x = spark.read.parquet(out)
    cols = [c for c in x.columns if c not in keys and c != "batch_id"]
    agg = x.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


# --------------------------------------------------------------------------- K1

def ingest_stream(spark: SparkSession, sf_dir: str, regions: list[str] | None = None, language: str | None = None,
                  max_files: int | None = None, score=None, index: UrlIndex | None = None) -> DataFrame:
    """K1: landed documents -> fetch rows -> per batch: normalise (A3), first
    arrival per URL (E1), unknown to what earlier batches stored (C1), region
    (B1), language (B2) -> append the job rows (A6).

    A batch asks the URL index, not the sink, what is stored, and reads only the
    index folders that its own URLs fall into. The job rows are written before
    their URLs, and the index is read as it stood before the batch, so a batch
    that breaks off between the two and is replayed writes both again.

    ``score(rows)`` turns a batch's new rows into the rows that are stored and
    returned instead (``ingest_scored`` as a stream); their URLs count as stored
    whether or not a profile wants them.
    """
    out = run_dir(spark, "ingest")
    index = index or UrlIndex(spark, run_dir(spark, "ingest-urls"))
    landed = read(spark, sf_dir, "documents")
    model = LG.learn(landed, "doc_id", "text", "lang")
    docs = file_stream(spark, sf_dir, "documents", max_files)
    rows = fetched(board_rows(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "nation")))

    def step(batch: DataFrame, batch_id: int):
        batch = materialize(I.normalize(batch), "ingest-batch")
        decided = I.decide(batch, index.known(batch.where(F.col("job_url").isNotNull()), batch_id), regions, language, model)
        at = os.path.join(out, "jobs", f"batch_id={batch_id}")
        # every batch file carries the sink schema, whatever the source had
        align_to(decided.filter(F.col("decision") == "new"), INGEST_SINK).write.mode("overwrite").parquet(at)
        new = spark.read.schema(INGEST_SINK).parquet(at)
        if score is not None:
            score(new).write.mode("overwrite").parquet(os.path.join(out, "scored", f"batch_id={batch_id}"))
        index.add(new, batch_id)

    _run(rows.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(out, "_checkpoint")))
    if score is not None:
        return spark.read.parquet(os.path.join(out, "scored")).drop("batch_id")
    return spark.read.schema(INGEST_SINK).parquet(os.path.join(out, "jobs"))


# --------------------------------------------------------------------------- K2

def feedback_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """K2: the feedback fold as a streaming aggregation in update mode."""
    out = run_dir(spark, "feedback")
    log = feedback_log(file_stream(spark, sf_dir, "events", max_files))
    state = FB.fold(log, ["profile_id", "listing_id"])
    _run(state.writeStream.outputMode("update")
         .foreachBatch(_batch_writer(out, lambda df, bid: df.withColumn("batch_id", F.lit(bid))))
         .option("checkpointLocation", os.path.join(out, "_checkpoint")))
    x = latest_per_key(spark, out, ["profile_id", "listing_id"])
    return x.select("profile_id", "listing_id", F.col("user_rating").cast("double").alias("user_rating"), "notes",
                    "is_applied", F.col("hidden").cast("string").alias("hidden"))


# --------------------------------------------------------------------------- K3

ACTIONS = {"approve": "apply", "reject": "discard", "freeform": "revise"}


def reply_actions(replies: DataFrame, proposals: DataFrame) -> DataFrame:
    """K3 step: match replies to proposals (C8), classify what the matched reply
    itself says (H12 takes quoted lines out, H11 in its strict mode, because the
    answer is acted on), and decide: approve -> apply, reject -> discard, else revise."""
    m = RP.match(replies, proposals)
    body = replies.select("uid", RP.intent(strip_quoted("body"), parity=False).alias("intent"))
    act = F.element_at(F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))]), F.col("intent"))
    return m.join(body, "uid").withColumn("action", act)


def replies_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """K3: each micro-batch of landed replies is matched, classified and turned
    into one action per proposal, and the proposal's state follows: ``applied``
    and ``discarded`` are final, ``revised`` waits for the next reply. A batch
    sees the states that earlier batches left and touches open proposals only;
    a References match never replaces an In-Reply-To match."""
    out = run_dir(spark, "replies")
    proposals = proposals_from(read(spark, sf_dir, "conversations"))
    inbox = replies_from(file_stream(spark, sf_dir, "conversations", max_files))

    def step(batch: DataFrame, batch_id: int):
        act = reply_actions(batch, proposals).withColumn("batch_id", F.lit(batch_id)).withColumn(
            "state", F.element_at(F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))]), F.col("action")))
        if not has_subdirs(spark, out, "batch_id="):
            return act
        before = proposal_states(spark, out, batch_id)
        closed = before.filter(F.col("state").isin("applied", "discarded"))
        direct = before.filter(F.col("matched_by") == "in_reply_to").select("proposal_id", F.lit("references").alias("matched_by"))
        return (act.join(closed, "proposal_id", "left_anti")
                .join(direct, ["proposal_id", "matched_by"], "left_anti"))

    _run(inbox.writeStream.foreachBatch(_batch_writer(out, step))
         .option("checkpointLocation", os.path.join(out, "_checkpoint")))
    return proposal_states(spark, out).select("proposal_id", "uid", "matched_by", "intent", "action", "state")


def acting_stream(spark: SparkSession, sf_dir: str, profiles: DataFrame, proposals: DataFrame, at: str,
                  max_files: int | None = None, compact_every: int = 10) -> ACT.Desk:
    """K3 with its effects: proposals are saved and mailed in batch 0, then every
    micro-batch of landed replies acts on the proposals still pending."""
    out = run_dir(spark, "acting")
    desk = ACT.open_desk(spark, os.path.join(out, "desk"), compact_every)
    desk.profiles.put(profiles, 0)
    ACT.propose(desk, proposals, 0)
    inbox = replies_from(file_stream(spark, sf_dir, "conversations", max_files))

    def step(batch: DataFrame, batch_id: int):
        act = reply_actions(batch, desk.active(batch_id + 1)).select("proposal_id", "uid", "action")
        said = batch.select("uid", strip_quoted("body").alias("reply"), F.concat(F.lit("<reply-"), F.col("uid").cast("string"), F.lit(">")).alias("reply_id"))
        ACT.act(desk, act.join(said, "uid").drop("uid"), batch_id + 1, at)

    _run(inbox.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(out, "_checkpoint")))
    return desk


STATES = {"apply": "applied", "discard": "discarded", "revise": "revised"}


def proposal_states(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The state of each proposal after the batches below ``before`` (all by default)."""
    x = spark.read.parquet(out)
    x = x if before is None else x.filter(F.col("batch_id") < before)
    cols = [c for c in x.columns if c not in ("proposal_id", "batch_id")]
    last = x.groupBy("proposal_id").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("r"))
    return last.select("proposal_id", "r.*")


# --------------------------------------------------------------------------- K4

def digest_stream(spark: SparkSession, sf_dir: str, as_of: str, ledger_dir: str | None = None) -> DataFrame:
    """K4: one digest per (profile, day). What the ledger already holds is left
    out before the cut to ``max_jobs_per_email``, so sent listings never hold a
    place; the day's rows go to a folder of their own (``sent_on=<day>``). A
    second run of a day, or a replayed batch, writes that day again from the
    other days' rows: the same rows, and no other day is touched."""
    from rankloom.plans.digest import board_candidates
    from rankloom.operators import digest as D
    ledger_dir = ledger_dir or run_dir(spark, "ledger")
    day = as_of[:10]
    trigger = file_stream(spark, sf_dir, "region")  # the daily tick: any landed file

    def step(_: DataFrame, batch_id: int):
        # a ledger that does not exist yet is an empty ledger (A5)
        have = (spark.read.schema(LEDGER).parquet(ledger_dir) if has_subdirs(spark, ledger_dir, "sent_on=")
                else spark.createDataFrame([], LEDGER))
        other = have.filter(F.col("sent_on") != F.lit(day).cast("date")).select("profile_id", "job_url")
        fresh = board_candidates(spark, sf_dir, as_of).join(other, ["profile_id", "job_url"], "left_anti")
        top = D.top_by_score(fresh, F.col("max_jobs_per_email"))
        rows = top.select("profile_id", "job_url", F.lit(as_of).cast("timestamp").alias("sent_at"))
        rows.write.mode("overwrite").parquet(os.path.join(ledger_dir, f"sent_on={day}"))

    # each run is one tick of its own; the ledger's day folders make it idempotent
    _run(trigger.writeStream.foreachBatch(step)
         .option("checkpointLocation", os.path.join(run_dir(spark, "digest-tick"), "_checkpoint")))
    return spark.read.schema(LEDGER).parquet(ledger_dir).select("profile_id", "job_url", "sent_at")


# --------------------------------------------------------------------------- K5

def activity_window(kind: str = "tumbling", size: str = "1 day", slide: str | None = None,
                    gap: str = "30 minutes"):
    """K5 window column: tumbling, sliding (``size`` every ``slide``) or
    session (closed after ``gap`` without events). Works in batch and stream."""
    if kind == "tumbling":
        return F.window("ts", size)
    if kind == "sliding":
        return F.window("ts", size, slide or size)
    if kind == "session":
        return F.session_window("ts", gap)
    raise ValueError(kind)


SESSIONS = "event_type string, window_start timestamp, window_end timestamp, n bigint"


def merged_sessions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions of ``old`` and ``new`` (``keys, window_start, window_end, n``; an end is
    the last event plus the gap) put together where they overlap, and rows with a
    true ``_deleted`` for starts of ``old`` that a longer session has taken in.

    Neighbours are found by the furthest end so far in order of the start; a
    window is one key's sessions around the new ones, not its events."""
    rows = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("window_start", "window_end")
    before = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("window_start") <= before, 0).otherwise(1)  # starting on the other's end is one session
    rows = rows.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy(*keys, "session").agg(F.min("window_start").alias("first"), F.max("window_end").alias("window_end"),
                                               F.sum("n").alias("n"), F.collect_set(F.when(F.col("old"), F.col("window_start"))).alias("had"))
    gone = whole.select(*keys, F.explode(F.array_except("had", F.array("first"))).alias("window_start"),
                        F.lit(None).cast("timestamp").alias("window_end"), F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("_deleted"))
    kept = whole.select(*keys, F.col("first").alias("window_start"), "window_end", "n", F.lit(False).alias("_deleted"))
    return kept.unionByName(gone)


def session_stream(spark: SparkSession, sf_dir: str, gap: str = "30 minutes", max_files: int | None = None,
                   compact_every: int = 10) -> DataFrame:
    """K5: session windows per event type as a stream, without a watermark: an event
    may come in any batch, lengthen a session or join two. A batch turns its own
    events into sessions, reads the stored sessions of its keys that touch the
    span of its events, merges both and stores what changed."""
    out = run_dir(spark, "sessions")
    state = StateTable(spark, os.path.join(out, "state"), ["event_type", "window_start"], SESSIONS, compact_every)
    ev = file_stream(spark, sf_dir, "events", max_files).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")

    def step(batch: DataFrame, batch_id: int):
        new = materialize(activity_counts(batch, ["event_type"], kind="session", gap=gap), "batch-sessions")
        span = new.groupBy("event_type").agg(F.min("window_start").alias("_from"), F.max("window_end").alias("_to"))
        # a span that a stored session reaches into grows by it once; stored sessions do not touch each other
        near = state.read(batch_id).join(span, "event_type").where(
            (F.col("window_end") >= F.col("_from")) & (F.col("window_start") <= F.col("_to"))).drop("_from", "_to")
        cols = ["event_type", "window_start", "window_end", "n"]
        state.put(merged_sessions(near.select(*cols), new.select(*cols), ["event_type"]), batch_id)

    _run(ev.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(out, "_checkpoint")))
    return state.read()


def activity_counts(events: DataFrame, keys: list[str], **window) -> DataFrame:
    """Events per window and key; the window is flattened to start/end."""
    w = activity_window(**window)
    return (events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"))


def activity_stream(spark: SparkSession, sf_dir: str, kind: str = "tumbling", size: str = "1 day",
                    slide: str | None = None, watermark: str | None = None, max_files: int | None = None) -> DataFrame:
    """K5: activity windows per event type as a stream (update mode; the latest
    value per window wins on read). Without a ``watermark`` no event is ever too
    late and the state keeps every window; with one, state is bounded and events
    later than it are left out, so the result may fall short of the batch query."""
    out = run_dir(spark, "activity")
    ev = file_stream(spark, sf_dir, "events", max_files).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev = ev.withWatermark("ts", watermark) if watermark else ev
    agg = ev.groupBy(activity_window(kind, size, slide), "event_type").agg(F.count("*").alias("n"))
    flat = lambda df, bid: df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                                     "event_type", "n", F.lit(bid).alias("batch_id"))
    _run(agg.writeStream.outputMode("update").foreachBatch(_batch_writer(out, flat))
         .option("checkpointLocation", os.path.join(out, "_checkpoint")))
    return latest_per_key(spark, out, ["window_start", "window_end", "event_type"])


# --------------------------------------------------------------------------- K6

INSIGHTS_EVERY = FB.INSIGHTS_THRESHOLD


INSIGHT_RUNS = "profile_id bigint, processed bigint, runs bigint"


def insight_runs_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, compact_every: int = 10,
                        on_run=None) -> DataFrame:
    """K6 with the trigger's state (A10): ``profile_id, processed, runs``, where
    ``processed`` is the count of rated-or-noted listings that earlier runs have
    taken in. A batch folds its events into the stored feedback (K2), counts the
    profiles that it touched, and every full 10 beyond ``processed`` is one run.
    ``on_run(rows, batch_id)`` gets ``profile_id, new_runs`` of the batch. Clearing
    feedback never takes a run back, and a replayed batch finds the state it had."""
    out = run_dir(spark, "insight-runs")
    keys = ["profile_id", "listing_id"]
    fold = StateTable(spark, os.path.join(out, "feedback"), keys, FEEDBACK_LATEST, compact_every)
    meta = StateTable(spark, os.path.join(out, "meta"), ["profile_id"], INSIGHT_RUNS, compact_every)
    log = feedback_log(file_stream(spark, sf_dir, "events", max_files))

    def step(batch: DataFrame, batch_id: int):
        new = FB.latest_events(batch, keys)
        old = fold.read(batch_id).join(new.select(*keys), keys, "left_semi")
        fold.put(FB.newer_of(old, new, keys), batch_id)
        touched = new.select("profile_id").distinct()
        now = FB.state_of(fold.read().join(touched, "profile_id", "left_semi")).groupBy("profile_id").agg(
            F.count_if(FB.B.rated_or_noted()).alias("n"))
        x = now.join(meta.read(batch_id), "profile_id", "left").na.fill(0, ["processed", "runs"])
        x = x.withColumn("new_runs", F.greatest(F.lit(0), F.expr(f"(n - processed) div {INSIGHTS_EVERY}")))
        changed = materialize(x.where("new_runs > 0").select(
            "profile_id", (F.col("processed") + INSIGHTS_EVERY * F.col("new_runs")).alias("processed"),
            (F.col("runs") + F.col("new_runs")).alias("runs"), "new_runs"), "insight-runs")
        if on_run is not None:
            on_run(changed.select("profile_id", "new_runs"), batch_id)
        meta.put(changed, batch_id)

    _run(log.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(out, "_checkpoint")))
    return meta.read()


FEEDBACK_LATEST = ", ".join(["profile_id bigint, listing_id bigint"] + [
    f"{k} struct<at:struct<ts:timestamp,seq:bigint>,value:string>" for k in FB.KINDS])


def insights_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """K6: the trigger on K2's state. The fold is kept as a streaming aggregate;
    from its latest rows the rated-or-noted listings of a profile are counted
    (D10: cleared ratings and notes, invalid ratings and repeats do not count),
    and every full 10 is one insights run."""
    state = feedback_stream(spark, sf_dir, max_files)
    n = state.groupBy("profile_id").agg(F.count_if(FB.B.rated_or_noted()).alias("n"))
    return n.select("profile_id", F.expr(f"n div {INSIGHTS_EVERY}").alias("runs"),
                    (F.col("n") % INSIGHTS_EVERY).alias("carried"))
