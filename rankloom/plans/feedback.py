"""Feedback queries: folded state, quarantine, sections, summary, counter, keyword suggestions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rankloom.operators import feedback as FB
from rankloom.operators import proposals as P
from rankloom.plans import oracle_views as V
from rankloom.plans.digest import BOARD_AS_OF
from rankloom.plans.registry import query
from rankloom.sources import listings as L

LAST_INSIGHTS_RUN = "2024-01-15 00:00:00"


def user_state(spark, sf_dir, before: str | None = None):
    ev = L.feedback_events(spark, sf_dir)
    if before:
        ev = ev.filter(F.col("ts") < F.lit(before).cast("timestamp"))
    return FB.fold(ev, ["profile_id", "listing_id"])


def state_view(state):
    """Result-set form of the folded state: the rating as a number that may be
    missing, the hide flag as text (``true``/``false``/NULL = never set)."""
    return state.select("profile_id", "listing_id", F.col("user_rating").cast("double").alias("user_rating"),
                        "notes", "is_applied", F.col("hidden").cast("string").alias("hidden"))


def state_rows(spark, sf_dir):
    """Folded per-user state with the listing's attributes (unknown listings drop)."""
    jobs = L.board_jobs(spark, sf_dir).select(
        F.col("id").alias("listing_id"), "job_url", "title", "employer", "score", "is_remote", "job_type",
        "discovered_at", F.col("hidden").alias("_base_hidden"))
    x = user_state(spark, sf_dir).join(jobs, "listing_id")
    return x.withColumn("hidden", F.coalesce("hidden", "_base_hidden")).drop("_base_hidden")


_FOLD = V.with_(V.BOARD_JOBS, V.FEEDBACK_EVENTS, V.fold_sql("fold"))
_ROWS = _FOLD + ",\n" + V.STATE_ROWS.strip()


@query("feedback_state", "G4", _FOLD + """
select profile_id, listing_id, cast(user_rating as double) as user_rating, notes, is_applied,
       cast(hidden as varchar) as hidden from fold""")
def feedback_state(spark, sf_dir):
    return state_view(user_state(spark, sf_dir))


@query("feedback_invalid", "B15", V.with_(V.FEEDBACK_EVENTS) + """
select profile_id, listing_id, seq, value, 'rating must be -1, 0 or 1' as reason from feedback_events
where kind = 'rate' and not coalesce(try_cast(value as int) in (-1, 0, 1), false)""")
def feedback_invalid(spark, sf_dir):
    return FB.invalid(L.feedback_events(spark, sf_dir)).select("profile_id", "listing_id", "seq", "value", "reason")


@query("feedback_sections", "D9 E5 F3 H22 H23 B11 B13", _ROWS + f""",
r0 as (select * from state_rows where (user_rating is not null or coalesce(notes, '') <> '')
                                  and coalesce(not hidden, false)),
newest as (select * from (select *, row_number() over (partition by profile_id order by discovered_at desc, job_url) as age
                          from r0) where age <= 200),
classed as (select *, case when user_rating = 1 then 'liked' when user_rating = -1 then 'disliked' else 'noted' end as cls
            from newest),
capped as (select * from (select *, row_number() over (partition by profile_id, cls order by age) as rn from classed)
           where rn <= case cls when 'liked' then 50 when 'disliked' then 50 else 30 end),
per_class as (select profile_id, count(*) as n,
                     case cls when 'liked' then 1 when 'disliked' then 2 else 3 end as o,
                     concat(upper(substr(cls, 1, 1)), substr(cls, 2), ':', chr(10),
                            string_agg('- ' || {V.FEEDBACK_LINE_SQL}, chr(10) order by rn)) as text
              from capped group by profile_id, cls)
select profile_id, cast(sum(n) as bigint) as n_rows, string_agg(text, chr(10) || chr(10) order by o) as sections
from per_class group by profile_id""")
def feedback_sections(spark, sf_dir):
    return FB.sections(state_rows(spark, sf_dir))


_SUMMARY_CUT = (datetime.fromisoformat(BOARD_AS_OF) - timedelta(days=FB.SUMMARY_DAYS)).date().isoformat()


FEEDBACK_SUMMARY_SQL = _ROWS + f""",
r0 as (select * from state_rows where (user_rating is not null or coalesce(notes, '') <> '')
                                  and cast(discovered_at as date) >= date '{_SUMMARY_CUT}'),
newest as (select * from (select *, row_number() over (partition by profile_id order by discovered_at desc, job_url) as age
                          from r0) where age <= 100),
counts as (select profile_id, cast(count_if(user_rating = 1) as bigint) as n_liked,
                  cast(count_if(user_rating = -1) as bigint) as n_disliked,
                  count_if(user_rating = 1 and coalesce(is_remote, false)) as lr from newest group by profile_id),
emp as (select profile_id, employer, count(*) as c from newest where user_rating = 1 group by profile_id, employer),
top_emp as (select profile_id, string_agg(employer, ', ' order by r) as te from
            (select *, row_number() over (partition by profile_id order by c desc, employer) as r from emp)
            where r <= 3 group by profile_id)
select c.profile_id, n_liked, n_disliked,
       case when n_liked > 0 then round(lr / n_liked, 4) else 0.0 end as remote_share,
       coalesce(te, '') as top_employers,
       concat('Liked ', cast(n_liked as varchar), ', disliked ', cast(n_disliked as varchar),
              '; liked employers: ', coalesce(nullif(te, ''), 'none')) as summary
from counts c left join top_emp t on t.profile_id = c.profile_id"""


@query("feedback_summary", "J10 B12 F4", FEEDBACK_SUMMARY_SQL)
def feedback_summary(spark, sf_dir):
    return FB.summary(state_rows(spark, sf_dir), BOARD_AS_OF)


@query("insights_counter", "D1 D10 A10", V.with_(V.FEEDBACK_EVENTS, V.fold_sql("fold_now"),
                                             V.fold_sql("fold_then", f"ts < timestamp '{LAST_INSIGHTS_RUN}'")) + """,
cur as (select profile_id, count_if(user_rating is not null or coalesce(notes, '') <> '') as c from fold_now group by 1),
done as (select profile_id, count_if(user_rating is not null or coalesce(notes, '') <> '') as p from fold_then group by 1)
select c.profile_id, cast(c.c as bigint) as current, cast(coalesce(d.p, 0) as bigint) as processed,
       cast(greatest(0, c.c - coalesce(d.p, 0)) as bigint) as new_feedback,
       greatest(0, c.c - coalesce(d.p, 0)) >= 10 as ready
from cur c left join done d on d.profile_id = c.profile_id""")
def insights_counter(spark, sf_dir):
    then = user_state(spark, sf_dir, before=LAST_INSIGHTS_RUN)
    processed = then.groupBy("profile_id").agg(F.count_if(FB.B.rated_or_noted()).alias("processed"))
    return FB.insights_counter(user_state(spark, sf_dir), processed)


KEYWORD_SUGGEST_SQL = (_ROWS + ",\n" + V.PROFILES_FLAT.strip() + ",\n" + V.SEGMENT_KEYWORDS_SQL.strip() + f""",
newest as (select *, row_number() over (partition by profile_id order by discovered_at desc, job_url) as age
           from state_rows where (user_rating is not null or coalesce(notes, '') <> '') and hidden = false),
rated as (select * from newest where age <= {FB.FEEDBACK_WINDOW} and user_rating in (1, -1)),
lt as (select distinct profile_id, job_url, user_rating, term from
        (select profile_id, job_url, user_rating, unnest({V.tokens_sql('title')}) as term from rated)
       where term <> ''),
n as (select profile_id, count(distinct job_url) filter (where user_rating = 1) as nl,
             count(distinct job_url) filter (where user_rating = -1) as nd from rated group by profile_id),
tf as (select profile_id, term, count(*) filter (where user_rating = 1) as l,
              count(*) filter (where user_rating = -1) as d from lt group by profile_id, term),
sc as (select t.profile_id, t.term, round(ln((l + 1) / (nl + 2)) - ln((d + 1) / (nd + 2)), 9) as s
       from tf t join n on n.profile_id = t.profile_id),
cur as (select p.profile_id, lower(k.keyword) as kw from profiles_flat p join segment_keywords k on k.segment = p.segment),
fresh as (select * from sc where not exists (select 1 from cur c where c.profile_id = sc.profile_id and c.kw = lower(sc.term))),
b as (select profile_id, 'boost' as kind, row_number() over (partition by profile_id order by s desc, term) as rank,
             term as keyword, cast(greatest(1, least(20, round(s * 10))) as int) as weight from fresh where s > 0),
p as (select profile_id, 'penalize' as kind, row_number() over (partition by profile_id order by s, term) as rank,
             term as keyword, cast(greatest(-50, least(-10, round(s * 10))) as int) as weight from fresh where s < 0)
select * from b where rank <= 5 union all select * from p where rank <= 5""")


@query("keyword_suggest", "J8 J11 C9", KEYWORD_SUGGEST_SQL)
def keyword_suggest(spark, sf_dir):
    rated = FB.newest_feedback(state_rows(spark, sf_dir)).filter(F.col("user_rating").isin(1, -1))
    cur = L.profiles(spark, sf_dir).select("profile_id", "scoring")
    return P.suggest_keywords(rated, cur)
