"""Scoring queries: keyword delta, relevance, requests, response parsing, retries, batch scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import keywords as KW
from rankloom.operators import relevance as R
from rankloom.operators import scoring as S
from rankloom.plans import oracle_views as V
from rankloom.plans.registry import query, sql_ts_text, ts_text
from rankloom.session import materialize
from rankloom.sources import listings as L
from rankloom.sources.tables import read


def _fleet_scored(spark, sf_dir):
    p = L.profiles(spark, sf_dir).select("profile_id", "scoring")
    x = L.fleet_jobs(spark, sf_dir).join(p, "profile_id")
    x = x.withColumn("delta", S.keyword_delta("description", "scoring.boost", "scoring.penalize"))
    return x.withColumn("adjusted", S.adjust("score", F.col("delta")))


_KD_SQL = V.with_(V.FLEET_JOBS, V.PROFILES_FLAT, V.SEGMENT_KEYWORDS_SQL, """
kd0 as (
  select j.profile_id, j.job_url, j.score,
         coalesce((select sum(cast(k.weight as double)) from segment_keywords k
                   where k.segment = p.segment and k.keyword <> ''
                     and contains(lower(j.description), lower(k.keyword))), 0.0) as raw_delta
  from fleet_jobs j join profiles_flat p on p.profile_id = j.profile_id),
kd as (
  select profile_id, job_url, score as raw_score, greatest(-20.0, least(20.0, raw_delta)) as delta,
         greatest(0.0, least(100.0, score + greatest(-20.0, least(20.0, raw_delta)))) as adjusted
  from kd0)""")


@query("keyword_delta", "C6 D8 H3", _KD_SQL + """
select profile_id, job_url, raw_score, delta, adjusted from kd""")
def keyword_delta(spark, sf_dir):
    return _fleet_scored(spark, sf_dir).select("profile_id", "job_url", F.col("score").alias("raw_score"),
                                               "delta", "adjusted")


@query("keyword_reason", "H4", _KD_SQL + """
select profile_id, job_url,
  case when round_even(adjusted - raw_score, 0) <> 0
       then concat('model score ', cast(raw_score as varchar), ' [',
                   case when round_even(adjusted - raw_score, 0) > 0 then '+' else '' end,
                   cast(cast(round_even(adjusted - raw_score, 0) as bigint) as varchar), 'pts entity boost]')
       else concat('model score ', cast(raw_score as varchar)) end as reason
from kd""")
def keyword_reason(spark, sf_dir):
    x = _fleet_scored(spark, sf_dir).withColumn("reason0", F.concat(F.lit("model score "), F.col("score").cast("string")))
    return x.select("profile_id", "job_url", S.boost_reason("reason0", "score", "adjusted").alias("reason"))


# The board profile's own keywords.
BOARD_BOOST = [("thing", 6.0), ("ation", 4.0)]
BOARD_PENALTY = [("!!", -20.0), ("***", -10.0)]

_SHARED_SQL = V.with_(V.PROFILES_FLAT, V.SEGMENT_KEYWORDS_SQL, f"""
who as (select profile_id, segment from profiles_flat union all select -1, 'BOARD'),
word as (select segment, lower(keyword) as keyword, weight from segment_keywords
         union all select 'BOARD', unnest({[k for k, _ in BOARD_BOOST + BOARD_PENALTY]}), unnest({[w for _, w in BOARD_BOOST + BOARD_PENALTY]})),
lead as (select segment, min(profile_id) as class_id from who group by segment),
hit as (select w.segment, d.doc_id, count(*) as n_hits, greatest(-20.0, least(20.0, sum(weight))) as delta
        from word w join documents d on contains(lower(d.text), w.keyword) group by all),
per as (select segment, count(*) as n_listings, cast(sum(n_hits) as bigint) as n_hits, cast(count_if(delta > 0) as bigint) as n_up,
               cast(count_if(delta < 0) as bigint) as n_down, arg_max(doc_id, (delta, -doc_id)) as best_id, max(delta) as best_delta
        from hit group by segment)""")


@query("keyword_shared", "C6 D8", _SHARED_SQL + """
select profile_id, class_id, n_listings, n_hits, n_up, n_down, best_id, best_delta
from who join lead using (segment) join per using (segment)""")
def keyword_shared(spark, sf_dir):
    """Every profile's keywords, the board's among them, against every landed
    listing: per profile the listings they move up and down and the best one.
    Deltas are made once per class of equal keyword lists."""
    def kw(items):
        return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for k, w in items])

    fleet = L.profiles(spark, sf_dir).select("profile_id", F.col("scoring.boost").alias("boost"), F.col("scoring.penalize").alias("penalize"))
    board = spark.range(1).select(F.lit(-1).cast("bigint").alias("profile_id"),  # beside the fleet's ids
                                  kw(BOARD_BOOST).alias("boost"), kw(BOARD_PENALTY).alias("penalize"))
    who = materialize(fleet.unionByName(board), "keyword-profiles")
    x = KW.shared_deltas(read(spark, sf_dir, "documents"), "doc_id", "text", who)
    per = x.groupBy("class_id").agg(
        F.count("*").alias("n_listings"), F.sum("n_hits").alias("n_hits"), F.count_if(F.col("delta") > 0).alias("n_up"),
        F.count_if(F.col("delta") < 0).alias("n_down"),
        F.max_by("doc_id", F.struct("delta", -F.col("doc_id"))).alias("best_id"), F.max("delta").alias("best_delta"))
    return KW.keyword_classes(who).join(per, "class_id").select(
        "profile_id", "class_id", "n_listings", "n_hits", "n_up", "n_down", "best_id", "best_delta")


def relevance_ctes(evidence: bool, p: str = "", bar: str = f"score >= {R.MIN_SCORE}") -> str:
    """CTEs ending in ``{p}rel`` (columns item_id, doc_id, n_terms, matched, total, score)."""
    lvl = "tf" if evidence else "1"
    return f"""
{p}dt as (select distinct doc, term from (select doc_id as doc, unnest({V.tokens_sql('text')}) as term from documents)),
{p}n as (select count(*) as n from documents),
{p}stats as (select term, count(*) as df from {p}dt group by term),
{p}weight as (select term, cast(round(100 * ln(x.n / df)) as bigint) as weight from {p}stats, {p}n x),
{p}qt as (select q, term, count(*) as tf from
        (select item_id as q, unnest({V.tokens_sql('text')}) as term from benchmark) group by q, term),
{p}qw as (select q, term, weight * {lvl} as w from {p}qt join {p}weight using (term)),
{p}total as (select q, sum(w) as total from {p}qw group by q),
{p}matched as (select q, doc, sum(w) as matched, count(*) as n_terms from {p}qw join {p}dt using (term) group by q, doc),
{p}rel as (
  select * from (
    select m.q as item_id, m.doc as doc_id, m.n_terms, cast(m.matched as bigint) as matched,
           cast(t.total as bigint) as total, cast(floor(100 * m.matched / t.total) as int) as score
    from {p}matched m join {p}total t using (q))
  where {bar})"""


def _relevance_sql(evidence: bool) -> str:
    return "with " + relevance_ctes(evidence).strip() + "\nselect * from rel"


TOP_LISTINGS = 5


@query("relevance_score", "J5 C5", _relevance_sql(False))
def relevance_score(spark, sf_dir):
    return R.relevance(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                       read(spark, sf_dir, "documents"), "doc_id", "text")


@query("relevance_top", "C5 J5 E3", "with " + relevance_ctes(False, bar="matched > 0").strip() + f"""
select item_id, pos, doc_id, matched, total, score from (
  select *, row_number() over (partition by item_id order by matched desc, doc_id) as pos from rel)
where pos <= {TOP_LISTINGS}""")
def relevance_top(spark, sf_dir):
    return R.relevance_top(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                           read(spark, sf_dir, "documents"), "doc_id", "text", TOP_LISTINGS)


@query("relevance_evidence", "J13", _relevance_sql(True))
def relevance_evidence(spark, sf_dir):
    return R.relevance(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                       read(spark, sf_dir, "documents"), "doc_id", "text", evidence=True)


def with_feedback(spark, sf_dir, profiles):
    """J10 in the loop: profiles carry the summary of their users' latest feedback."""
    from rankloom.plans.feedback import feedback_summary
    s = feedback_summary(spark, sf_dir).select("profile_id", "summary")
    return (profiles.drop("feedback_summary").join(s, "profile_id", "left")
            .withColumnRenamed("summary", "feedback_summary"))


def _feedback_sql():
    from rankloom.plans import feedback
    return feedback.FEEDBACK_SUMMARY_SQL


@query("scoring_requests", "J1 H8 J10", V.with_(V.FLEET_JOBS, V.PROFILES_FLAT) + f""",
fb as ({_feedback_sql()})
select j.profile_id, j.job_url, concat_ws(chr(10),
  'Rate the fit between this candidate and this listing from 0 to 100.', '{S.SCORE_GUIDE}',
  concat('CANDIDATE: ', case when fb.summary is null
    then to_json({{'resume': concat('Buyer in ', lower(p.segment)), 'description': c.c_name}})
    else to_json({{'resume': concat('Buyer in ', lower(p.segment)), 'description': c.c_name, 'feedback': fb.summary}}) end),
  concat('TITLE: ', coalesce(j.title, '')), concat('EMPLOYER: ', coalesce(j.employer, '')),
  concat('LOCATION: ', coalesce(j.location, '')), concat('DESCRIPTION: ', coalesce(j.description, '')),
  'Answer as JSON: {{"score": <0-100>, "reason": "<why>"}}') as request
from fleet_jobs j join profiles_flat p on p.profile_id = j.profile_id
left join fb on fb.profile_id = j.profile_id
join customer c on c.c_custkey = j.profile_id""")
def scoring_requests(spark, sf_dir):
    p = with_feedback(spark, sf_dir, L.profiles(spark, sf_dir)).select(
        "profile_id", "resume", F.col("description").alias("p_description"), "feedback_summary")
    x = L.fleet_jobs(spark, sf_dir).join(p, "profile_id")
    return x.select("profile_id", "job_url", S.scoring_request(
        "resume", "p_description", "feedback_summary", "title", "employer", "location", "description").alias("request"))


def model_answers(spark, sf_dir):
    """Scorer answers as landed, one per ``events`` row, in every shape a model
    returns: fenced JSON, numeric text, decimals, prose, a missing key."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    et, v = F.col("event_type"), F.col("value")
    raw = (F.when(et == "purchase", F.concat(F.lit('```json\n{"score": '), F.floor(v * 3).cast("string"),
                                             F.lit(', "reason": "strong match"}\n```')))
           .when(et == "click", F.concat(F.lit('{"score": "'), F.floor(v * 2).cast("string"),
                                         F.lit('", "reason": "text score"}')))
           .when(et == "signup", F.concat(F.lit('  {"score": '), F.round(v * 4, 2).cast("decimal(12,2)").cast("string"),
                                          F.lit(', "reason": "decimal"}  ')))
           .when(et == "view", F.lit('{"reason": "no score given"}'))
           .otherwise(F.lit("Sorry, I cannot rate this listing.")))
    return e.select("event_id", raw.alias("raw"))


_ANSWERS_SQL = """
with answers as (
  select event_id, case
    when event_type = 'purchase' then concat('```json' || chr(10) || '{"score": ', cast(cast(floor(value * 3) as bigint) as varchar), ', "reason": "strong match"}' || chr(10) || '```')
    when event_type = 'click' then concat('{"score": "', cast(cast(floor(value * 2) as bigint) as varchar), '", "reason": "text score"}')
    when event_type = 'signup' then concat('  {"score": ', cast(cast(round(value * 4, 2) as decimal(12, 2)) as varchar), ', "reason": "decimal"}  ')
    when event_type = 'view' then '{"reason": "no score given"}'
    else 'Sorry, I cannot rate this listing.' end as raw
  from events),
b as (select event_id, regexp_replace(
        case when contains(raw, '```') then regexp_replace(coalesce(split_part(raw, '```', 2), ''), '^json', '') else raw end,
        '^\\s+|\\s+$', '', 'g') as body from answers),
j as (select event_id, body,
        case when json_valid(body) then try_cast(trim(json_extract_string(body, '$.score')) as double) end as s,
        case when json_valid(body) then json_extract_string(body, '$.reason') end as r from b),
t as (select event_id, case when s < 0 then ceil(s) else floor(s) end as n, r from j)
select event_id,
  case when n is not null then cast(greatest(0, least(100, n)) as double) else 0.0 end as score,
  case when n is not null then coalesce(r, '') else 'Scoring unavailable' end as reason
from t"""


@query("score_parse", "J2 H5 H6 H7", _ANSWERS_SQL)
def score_parse(spark, sf_dir):
    score, reason = S.parse_score(F.col("raw"))
    return model_answers(spark, sf_dir).select("event_id", score.alias("score"), reason.alias("reason"))


def scoring_attempts(spark, sf_dir):
    """The scorer's work queue as landed: one row per call attempt."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    status = (F.when(et == "error", "500").when(et == "view", "429").when(et == "signup", "transport")
              .when(et == "click", "200").otherwise("400"))
    return e.select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("request_id"),
        (F.lit(1) + F.pmod(F.floor("value"), F.lit(4))).cast("int").alias("attempt"),
        status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


@query("retry_eligible", "J4", f"""
with a as (
  select concat_ws(':', cast(user_id as varchar), json_extract_string(props, '$.k')) as request_id,
         cast(1 + (floor(value) % 4) as int) as attempt,
         case event_type when 'error' then '500' when 'view' then '429' when 'signup' then 'transport'
                         when 'click' then '200' else '400' end as status, ts as "at"
  from events),
l as (select *, row_number() over (partition by request_id order by attempt desc, "at" desc) as rn,
             count(*) over (partition by request_id) as n_attempts from a)
select request_id, n_attempts, attempt, status, {sql_ts_text('"at"', True)} as "at",
       {sql_ts_text('"at" + to_seconds(cast(5 * pow(2, attempt - 1) as bigint))', True)} as next_at
from l where rn = 1 and status <> '200' and attempt < 3""")
def retry_eligible(spark, sf_dir):
    x = S.retry_eligible(scoring_attempts(spark, sf_dir))
    return x.select("request_id", "n_attempts", "attempt", "status", ts_text("at", True).alias("at"),
                    ts_text("next_at", True).alias("next_at"))


@query("scorer_batch", "J3", V.with_(V.FLEET_JOBS, V.PROFILES_FLAT, """
w as (select j.profile_id, j.job_url, ['buyer', 'in', lower(p.segment)] as want,
             string_split_regex(lower(j.description), '\\s+') as have
      from fleet_jobs j join profiles_flat p on p.profile_id = j.profile_id),
s as (select profile_id, job_url, cast(floor(100 * len(list_intersect(want, have)) / 3) as double) as score from w)""") + """
select *, cast(cast(score as int) as varchar) || '% of profile words present' as reason from s""")
def scorer_batch(spark, sf_dir):
    p = L.profiles(spark, sf_dir).select("profile_id", "resume")
    req = L.fleet_jobs(spark, sf_dir).join(p, "profile_id")
    return S.batch_score(req)
