"""History queries over the board profile's listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import feedback as FB
from rankloom.operators import history as H
from rankloom.plans import oracle_views as V
from rankloom.plans.digest import BOARD_AS_OF
from rankloom.plans.registry import query, sql_ts_text, ts_text
from rankloom.sources import listings as L

SEARCH_Q = "ou"
SENT_DAY = "2024-01-03"
PAGE_NO = 3
PAST_THE_END = 1_000_000


def board_state(spark, sf_dir):
    """Board listings with the user's folded feedback and the sent map."""
    state = FB.fold(L.feedback_events(spark, sf_dir), ["listing_id"]).withColumnRenamed("listing_id", "id")
    jobs = FB.apply_state(L.board_jobs(spark, sf_dir), state, ["id"])
    return H.with_sent(jobs, L.board_sent_ledger(spark, sf_dir, BOARD_AS_OF))


BOARD_STATE_SQL = V.with_(V.BOARD_JOBS, V.board_ledger(BOARD_AS_OF), V.FEEDBACK_EVENTS,
                          V.fold_sql("bfold", keys="listing_id"), """
board_state as (
  select j.* replace (
           (case when coalesce(f.has_rating, false) then f.user_rating else j.user_rating end) as user_rating,
           (case when f.hidden is not null then f.hidden else j.hidden end) as hidden),
         case when coalesce(f.has_note, false) then f.notes end as notes,
         coalesce(f.is_applied, false) as is_applied,
         s.sent_at, s.sent_at is not null as sent
  from board_jobs j left join bfold f on f.listing_id = j.id
  left join board_ledger s on s.profile_id = j.profile_id and s.job_url = j.job_url)""")


@query("history_liked", "B6 B8 C3 F2 D2 E6", BOARD_STATE_SQL + """,
v as (select * from board_state where coalesce(not hidden, true) and user_rating = 1),
t as (select count(*) as total from v)
select r.profile_id, r.pos, r.job_url, r.score, r.sent, t.total
from (select *, row_number() over (order by score desc, discovered_at desc, job_url) as pos from v) r, t
where r.pos <= 25""")
def history_liked(spark, sf_dir):
    """First page of the liked filter in score order (the history view): a
    distributed top-25 (``orderBy.limit``), not a sort of the whole group."""
    rows = H.select_history(board_state(spark, sf_dir), filter_name="liked")
    return H.first_page(rows, "score").select("profile_id", "pos", "job_url", "score", "sent", "total")


@query("history_sent_day", "B8 B10", BOARD_STATE_SQL + f"""
select profile_id, job_url, {sql_ts_text('sent_at', True)} as sent_at
from board_state where coalesce(not hidden, true) and sent
  and starts_with({sql_ts_text('sent_at')}, '{SENT_DAY}')""")
def history_sent_day(spark, sf_dir):
    x = H.select_history(board_state(spark, sf_dir), filter_name="sent", sent_day=SENT_DAY)
    return x.select("profile_id", "job_url", ts_text("sent_at", True).alias("sent_at"))


@query("history_search", "B9", BOARD_STATE_SQL + f"""
select profile_id, job_url, title, employer from board_state
where coalesce(not hidden, true)
  and (lower(title) like '%{SEARCH_Q}%' or lower(employer) like '%{SEARCH_Q}%')""")
def history_search(spark, sf_dir):
    x = H.select_history(board_state(spark, sf_dir), q=SEARCH_Q)
    return x.select("profile_id", "job_url", "title", "employer")


def _page_sql(number: int) -> str:
    return BOARD_STATE_SQL + f""",
v as (select * from board_state where coalesce(not hidden, true)),
t as (select count(*) as total from v),
p as (select total, greatest(1, cast(ceil(total / 25) as bigint)) as pages from t),
r as (select v.*, row_number() over (order by try_cast(left(date_posted, 10) as date) desc nulls last,
                                       discovered_at desc nulls last, job_url) as rn from v)
select r.rn as pos, r.job_url, r.date_posted, p.total, p.pages, least(greatest({number}, 1), p.pages) as page
from r, p
where r.rn > (least(greatest({number}, 1), p.pages) - 1) * 25 and r.rn <= least(greatest({number}, 1), p.pages) * 25"""


def _page(spark, sf_dir, number):
    rows = H.select_history(board_state(spark, sf_dir))
    return H.Pages(rows, "posted").page(number).select("pos", "job_url", "date_posted", "total", "pages", "page")


@query("history_page", "D2 E6 F2", _page_sql(PAGE_NO))
def history_page(spark, sf_dir):
    return _page(spark, sf_dir, PAGE_NO)


@query("history_last_page", "D2 E6 F2", _page_sql(PAST_THE_END))
def history_last_page(spark, sf_dir):
    """A page past the end is the last one; it reads the last ranges only."""
    return _page(spark, sf_dir, PAST_THE_END)


@query("sent_days", "D3", V.with_(V.BOARD_JOBS, V.board_ledger(BOARD_AS_OF)) + """
select distinct profile_id, cast(cast(sent_at as date) as varchar) as day from board_ledger""")
def sent_days(spark, sf_dir):
    return H.sent_days(L.board_sent_ledger(spark, sf_dir, BOARD_AS_OF))


@query("last_ingest", "D4", V.with_(V.FLEET_JOBS) + f"""
select profile_id, {sql_ts_text('max(discovered_at)')} as last_ingest from fleet_jobs group by profile_id""")
def last_ingest(spark, sf_dir):
    x = H.last_ingest(L.fleet_jobs(spark, sf_dir))
    return x.select("profile_id", ts_text("last_ingest").alias("last_ingest"))


@query("retain_sent", "C4 D13 G5", V.with_(V.BOARD_JOBS, V.board_ledger(BOARD_AS_OF)) + """
select j.profile_id, j.job_url,
       exists (select 1 from board_ledger s where s.profile_id = j.profile_id and s.job_url = j.job_url) as kept
from board_jobs j""")
def retain_sent(spark, sf_dir):
    x = H.retain_sent(L.board_jobs(spark, sf_dir), L.board_sent_ledger(spark, sf_dir, BOARD_AS_OF))
    return x.select("profile_id", "job_url", "kept")
