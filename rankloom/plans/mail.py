"""Digest mails: header, texts and page of what the re-ranking chain leaves (F6 -> E3 -> D7, H14-H18, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import render as R
from rankloom.operators import digest as D
from rankloom.plans.digest import FLEET_AS_OF, FLEET_CAND_SQL, FLEET_TOP_SQL, fleet_cand_cte, fleet_candidates, fleet_top, fleet_unsent, most_of
from rankloom.plans.registry import query
from rankloom.plans.rerank import RERANKED_SQL, reranked
from rankloom.session import materialize
from rankloom.sources import listings as L
from rankloom.sources.tables import read
from rankloom.streaming import dispatch as DP
from rankloom.streaming.streams import run_dir

RERANKED_TOP_SQL = RERANKED_SQL + """,
fleet_top as (select f.* exclude (pos), t.pos from reranked t
              join fleet_cut f on f.profile_id = t.profile_id and f.job_url = t.job_url)"""


def reranked_top(spark, sf_dir):
    """The listings to send, in the order the chain gave them, with their details."""
    top, cut = reranked(spark, sf_dir)
    rows = cut.drop("pos", "idx").join(top.select("profile_id", "job_url", "pos"), ["profile_id", "job_url"])
    return L.fleet_details(spark, sf_dir, rows)


@query("digest_header", "D7 H15", RERANKED_TOP_SQL + """
select profile_id, count(*) as job_count, arg_min(score, pos) as top_score,
       replace(replace('{count} new matches - top score {top_score}', '{count}', cast(count(*) as varchar)),
               '{top_score}', cast(arg_min(score, pos) as varchar)) as subject
from fleet_top group by profile_id""")
def digest_header(spark, sf_dir):
    msgs = R.digest_messages(reranked_top(spark, sf_dir).withColumn("company", F.col("employer")),
                             L.profiles(spark, sf_dir), FLEET_AS_OF)
    return msgs.select("profile_id", "job_count", "top_score", "subject")


def _sql_esc(x: str) -> str:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_SQL_BADGE = ("array_to_string(list_transform(regexp_extract_all(lower(replace(job_type, '_', ' ')), '[a-z]+|[^a-z]+'), "
              "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')")

DIGEST_RENDER_SQL = RERANKED_TOP_SQL + f""",
cards as (
  select profile_id, pos, score,
    concat('<li><span style=''background:', case when score >= 70 then '#22c55e' else '#eab308' end, '''>',
           cast(score as varchar), '/100</span>',
           case when coalesce(is_remote, false) then '<b class=''badge''>Remote</b>' else '' end,
           case when coalesce(job_type, '') <> '' then concat('<b class=''badge''>', {_sql_esc(_SQL_BADGE)}, '</b>') else '' end,
           '<h3>', {_sql_esc("coalesce(title, '')")}, '</h3><p>', {_sql_esc("coalesce(employer, '')")}, ' | ',
           {_sql_esc("coalesce(location, '')")},
           case when coalesce(date_posted, '') <> '' then concat(' | posted ', {_sql_esc('date_posted')}) else '' end,
           '</p><a href=''', {_sql_esc('job_url')}, '''>View</a></li>') as card
  from fleet_top)
select profile_id, count(*) as job_count, arg_min(score, pos) as top_score,
       replace(replace('{{count}} new jobs, best {{top_score}}', '{{count}}', cast(count(*) as varchar)),
               '{{top_score}}', cast(arg_min(score, pos) as varchar)) as chat_text,
       concat('<html><body><h1>', cast(count(*) as varchar), ' new jobs today</h1><p>Top match: ',
              cast(arg_min(score, pos) as varchar), '/100 | ', strftime(timestamp '{FLEET_AS_OF}', '%B %d, %Y'),
              '</p><ul>', string_agg(card, chr(10) order by pos), '</ul></body></html>') as html
from cards group by profile_id"""


@query("digest_render", "H14 H16 H17 H18 A13", DIGEST_RENDER_SQL)
def digest_render(spark, sf_dir):
    top = reranked_top(spark, sf_dir).withColumn("company", F.col("employer"))
    msgs = R.digest_messages(top, L.profiles(spark, sf_dir), FLEET_AS_OF)
    return msgs.select("profile_id", "job_count", "top_score", "chat_text", "html")


@query("digest_test", "D7 E4 H15", FLEET_TOP_SQL + """
select profile_id, count(*) as job_count, arg_min(score, pos) as top_score,
       '[TEST] ' || cast(count(*) as varchar) || ' new matches - top score ' || cast(arg_min(score, pos) as varchar) as subject,
       '[TEST] ' || cast(count(*) as varchar) || ' new jobs, best ' || cast(arg_min(score, pos) as varchar) as chat_text
from fleet_top group by profile_id""")
def digest_test(spark, sf_dir):
    """A trial digest: score order, no re-ranking, nothing marked as sent."""
    top = fleet_top(spark, sf_dir).withColumn("company", F.col("employer"))
    msgs = R.digest_messages(top, L.profiles(spark, sf_dir), FLEET_AS_OF)
    mark = lambda c: F.concat(F.lit("[TEST] "), F.col(c)).alias(c)
    return msgs.select("profile_id", "job_count", "top_score", mark("subject"), mark("chat_text"))


NEXT_DAY = "1998-06-02 00:00:00"


def _sent_sql(name: str, cand: str, day: str, batch: int, without: str = "true") -> str:
    return f""",
{name} as (
  select *, '{day}' as day, {batch} as batch from (
    select *, row_number() over (partition by profile_id order by score desc, job_url) as pos from {cand} c where {without})
  where pos <= max_jobs_per_email)"""


@query("digest_outbox", "A13 A7 C2 K4 D7", FLEET_CAND_SQL + _sent_sql("first_day", "fleet_cand", FLEET_AS_OF[:10], 0) + ","
       + fleet_cand_cte("next_cand", NEXT_DAY) + _sent_sql("next_day", "next_cand", NEXT_DAY[:10], 1,
       "not exists (select 1 from first_day f where f.profile_id = c.profile_id and f.job_url = c.job_url)") + """
select concat_ws('/', profile_id, day, batch) as message_key, profile_id, lower(c.c_name) || '@example.org' as recipient,
       count(*) || ' new matches - top score ' || arg_min(score, pos) as subject,
       string_agg(pos || '. ' || title || ' at ' || employer || ' (' || location || '), ' || score || '/100, ' || job_url, chr(10) order by pos) as text
from (select * from first_day union all select * from next_day) x join customer c on c.c_custkey = x.profile_id
where c.c_custkey % 10 <> 0 group by profile_id, day, batch, c.c_name""")
def digest_outbox(spark, sf_dir):
    """The mails of two days for every profile with an address: the second day's
    digests leave out what the first has put into the ledger."""
    names = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"), F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).alias("recipient"))
    people = L.profiles(spark, sf_dir).join(names, "profile_id")
    box = DP.open_mailer(spark, run_dir(spark, "mailer"))
    most = most_of(spark, sf_dir, "max_jobs_per_email")
    listings = materialize(fleet_unsent(spark, sf_dir), "unsent-listings")  # both days choose from them

    for batch, as_of in enumerate((FLEET_AS_OF, NEXT_DAY)):
        def choose(sent, as_of=as_of):
            fresh = fleet_candidates(spark, sf_dir, as_of, listings).join(sent.select("profile_id", "job_url"), ["profile_id", "job_url"], "left_anti")
            top = D.top_by_score(fresh, F.col("max_jobs_per_email"), most=most)
            return L.fleet_details(spark, sf_dir, top).withColumn("company", F.col("employer"))
        DP.send_digest(box, batch, as_of, choose, people)
    return box.outbox.read().select("message_key", "profile_id", "recipient", "subject", "text")
