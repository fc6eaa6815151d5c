"""Streaming queries (K1-K6); each drains its file stream with an
``availableNow`` trigger and returns the sink table. Their oracles are the
batch queries they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans import digest as DG
from rankloom.plans import oracle_views as V
from rankloom.plans import feedback as FBQ  # noqa: F401  registers the batch oracles used below
from rankloom.plans import ingest as IQ
from rankloom.plans import proposals as PQ
from rankloom.plans.registry import REGISTRY, query, sql_ts_text, ts_text
from rankloom.sources.inbox import proposals_from
from rankloom.sources.tables import read
from rankloom.streaming import acting as ACT
from rankloom.streaming import streams as ST


SESSION_GAP = "30 minutes"


_STREAMED_SQL = V.with_(V.RAW_FETCH, """
batch as (select * from raw_fetch),
known as (select job_url from batch where false)""") + IQ.decided_ctes()


@query("stream_ingest", "K1 A3 A6 A12 B1 B2 C1 E1 G1", _STREAMED_SQL + """
select id, job_url, coalesce(title, '') as title, coalesce(company, '') as employer, coalesce(location, '') as location
from decided where decision = 'new'""")
def stream_ingest(spark, sf_dir):
    x = ST.ingest_stream(spark, sf_dir, IQ.BOARD_REGIONS, IQ.BOARD_LANGUAGE)
    return x.select("id", "job_url", "title", "employer", "location")


@query("stream_ingest_scored", "K1 A6 J5 D8", _STREAMED_SQL + IQ.SCORED_CTES + """
select profile_id, id, job_url, title, employer, raw_score, delta, score from jobs""")
def stream_ingest_scored(spark, sf_dir):
    """The scored ingest as a stream: each batch's new listings for every profile."""
    x = ST.ingest_stream(spark, sf_dir, IQ.BOARD_REGIONS, IQ.BOARD_LANGUAGE, score=lambda new: IQ.score_new(spark, sf_dir, new))
    return x.select("profile_id", "id", "job_url", "title", "employer", "raw_score", "delta", "score")


@query("stream_feedback", "K2", REGISTRY["feedback_state"].sql)
def stream_feedback(spark, sf_dir):
    return ST.feedback_stream(spark, sf_dir)


_NEG = ", ".join(repr(w) if "'" not in w else "'" + w.replace("'", "''") + "'" for w in PQ.RP.NEGATIONS)


@query("stream_replies", "K3 C8 H11 H12", "with " + PQ.REPLY_MATCH_CTES + f""",
said as (
  select conv_id, turn, case conv_id % 4 when 0 then 'Reject, thanks' when 1 then 'yes please' when 2 then 'no' else text end as t0
  from conversations where role = 'user'),
w0 as (select conv_id, turn, regexp_replace(lower((string_split_regex(regexp_replace(t0, '^\\s+', ''), '\\s+'))[1]),
                                            '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g') as w from said),
w1 as (select *, regexp_replace(w, '[^\\x00-\\x7F]', '#', 'g') as wa from w0),
x as (select m.*,
        case when w in ({', '.join(repr(x) for x in PQ.RP.APPROVE_WORDS)}) then 'approve'
             when w in ({', '.join(repr(x) for x in PQ.RP.REJECT_WORDS)}) then 'reject'
             when {PQ._fuzzy_sql(PQ.RP.APPROVE_WORDS)} and length(w) >= 4 and w not in ({_NEG}) then 'approve'
             when {PQ._fuzzy_sql(PQ.RP.REJECT_WORDS)} and length(w) >= 4 then 'reject'
             else 'freeform' end as intent
      from m join w1 on w1.conv_id = m.uid // 1000 and w1.turn = m.uid % 1000)
select proposal_id, uid, matched_by, intent,
       case intent when 'approve' then 'apply' when 'reject' then 'discard' else 'revise' end as action,
       case intent when 'approve' then 'applied' when 'reject' then 'discarded' else 'revised' end as state
from x""")
def stream_replies(spark, sf_dir):
    return ST.replies_stream(spark, sf_dir)


ACTED_AT = "2024-01-31 18:00:00"


def desk_tables(spark, sf_dir):
    """Per conversation a profile and the proposal that its replies answer."""
    conv = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    word = F.concat(F.lit("topic"), (F.col("conv_id") % 7).cast("string"))
    people = conv.select(
        F.col("conv_id").alias("profile_id"), F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.org")).alias("recipient"),
        F.struct(F.array(F.struct(F.lit("TOPIC0").alias("keyword"), F.lit(3.0).alias("weight"))).alias("boost"),
                 F.array().cast(ACT.KEYWORDS).alias("penalize")).alias("scoring"),
        F.struct(F.array(F.lit("reader")).alias("terms")).alias("search"))
    new = proposals_from(conv).select(
        "proposal_id", F.col("proposal_id").alias("profile_id"), "message_id", F.lit("pending").alias("status"), F.lit("Because").alias("summary"),
        F.array(F.struct(F.concat(F.lit("topic"), (F.col("proposal_id") % 7).cast("string")).alias("keyword"), F.lit(8.0).alias("weight"))).alias("boost_add"),
        F.array(F.struct(F.lit("spam").alias("keyword"), F.lit(-20.0).alias("weight"))).alias("penalize_add"),
        F.array(F.lit("writer")).alias("terms_add"), F.array().cast("array<struct<role:string,content:string>>").alias("conversation"))
    return people, new


@query("stream_acting", "K3 J12 C9 A9 A13", REGISTRY["stream_replies"].sql.rsplit("select proposal_id, uid, matched_by, intent,", 1)[0] + """,
every as (select distinct conv_id as profile_id from conversations)
select e.profile_id,
       case intent when 'approve' then 'applied' when 'reject' then 'discarded' else 'pending' end as status,
       case when intent = 'approve' and e.profile_id % 7 <> 0 then 'TOPIC0,topic' || (e.profile_id % 7) else 'TOPIC0' end as boost,
       case when intent = 'approve' then 'spam' else '' end as penalize,
       case when intent = 'approve' then 'reader,writer' else 'reader' end as terms,
       case when intent is null then 'proposal' else 'proposal,' || case intent when 'approve' then 'applied' when 'reject' then 'discarded' else 'revised' end end as mails
from every e left join x on x.proposal_id = e.profile_id""")
def stream_acting(spark, sf_dir):
    """What the landed replies have made of every conversation's profile and proposal, and what was mailed."""
    desk = ST.acting_stream(spark, sf_dir, *desk_tables(spark, sf_dir), ACTED_AT)
    names = lambda c: F.array_join(F.transform(c, lambda k: k["keyword"]), ",")
    mails = desk.outbox.read().groupBy("profile_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("batch", "kind"))), lambda m: m["kind"]), ",").alias("mails"))
    return (desk.profiles.read().select("profile_id", names("scoring.boost").alias("boost"), names("scoring.penalize").alias("penalize"),
                                        F.array_join("search.terms", ",").alias("terms"))
            .join(desk.proposals.read().select("profile_id", "status"), "profile_id").join(mails, "profile_id"))


@query("stream_digest", "K4 A5 A7", DG.BOARD_CAND_SQL + f"""
select profile_id, job_url, {sql_ts_text(f"timestamp '{DG.BOARD_AS_OF}'")} as sent_at
from (select *, row_number() over (partition by profile_id order by score desc, job_url) as pos from board_cand)
where pos <= 5""")
def stream_digest(spark, sf_dir):
    x = ST.digest_stream(spark, sf_dir, DG.BOARD_AS_OF)
    return x.select("profile_id", "job_url", ts_text("sent_at").alias("sent_at"))


@query("stream_activity", "K5", f"""
select {sql_ts_text("date_trunc('day', ts)")} as window_start, event_type, count(*) as n
from events group by all""")
def stream_activity(spark, sf_dir):
    x = ST.activity_stream(spark, sf_dir)
    return x.select(ts_text("window_start").alias("window_start"), "event_type", "n")


@query("stream_sliding", "K5", f"""
with h as (select event_type, date_trunc('hour', ts) as hour from events),
s as (select event_type, hour - to_hours(k) as start from h, (select unnest(range(24)) as k))
select {sql_ts_text("start")} as window_start, event_type, count(*) as n
from s where epoch(start) % (6 * 3600) = 0 group by all""")
def stream_sliding(spark, sf_dir):
    """24-hour windows, every six hours."""
    x = ST.activity_stream(spark, sf_dir, "sliding", "24 hours", "6 hours")
    return x.select(ts_text("window_start").alias("window_start"), "event_type", "n")


@query("stream_sessions", "K5", f"""
with e as (select event_type, ts, lag(ts) over (partition by event_type order by ts) as before from events),
s as (select event_type, ts, sum(case when before >= ts - interval {SESSION_GAP} then 0 else 1 end)
             over (partition by event_type order by ts rows unbounded preceding) as session from e)
select event_type, {sql_ts_text("min(ts)", True)} as window_start, {sql_ts_text(f"max(ts) + interval {SESSION_GAP}", True)} as window_end,
       count(*) as n
from s group by event_type, session""")
def stream_sessions(spark, sf_dir):
    x = ST.session_stream(spark, sf_dir, SESSION_GAP)
    return x.select("event_type", ts_text("window_start", True).alias("window_start"), ts_text("window_end", True).alias("window_end"), "n")


@query("stream_insight_runs", "K6 A10 D10", f"""
select profile_id, (c // {ST.INSIGHTS_EVERY}) * {ST.INSIGHTS_EVERY} as processed, c // {ST.INSIGHTS_EVERY} as runs from (
  {V.with_(V.FEEDBACK_EVENTS, V.fold_sql("fold_now"))}
  select profile_id, count_if(user_rating is not null or coalesce(notes, '') <> '') as c from fold_now group by 1)
where c >= {ST.INSIGHTS_EVERY}""")
def stream_insight_runs(spark, sf_dir):
    return ST.insight_runs_stream(spark, sf_dir)


@query("stream_insights", "K6 D10", f"""
select profile_id, c // {ST.INSIGHTS_EVERY} as runs, c % {ST.INSIGHTS_EVERY} as carried from (
  {V.with_(V.FEEDBACK_EVENTS, V.fold_sql("fold_now"))}
  select profile_id, count_if(user_rating is not null or coalesce(notes, '') <> '') as c from fold_now group by 1)""")
def stream_insights(spark, sf_dir):
    return ST.insights_stream(spark, sf_dir)
