"""DuckDB text of the derived inputs (see ``rankloom.sources.listings``).

Used only to build oracle SQL; each is a CTE body over the landed tables.
"""

from rankloom.operators import language as LG

LISTINGS_RAW = """
listings_raw as (
  select d.doc_id as id,
         concat('https://l.example/', md5(d.text)) as job_url,
         split_part(d.text, '.', 1) as title,
         d.source as employer, n.n_name as location, d.text as description, d.lang as language,
         cast((d.doc_id * 37) % 101 as int) as score,
         (d.doc_id % 5 = 0) as is_remote,
         case d.doc_id % 4 when 0 then 'full_time' when 1 then 'part_time' when 2 then 'contract' else '' end as job_type,
         case when d.doc_id % 7 = 0 then 'nan' when d.doc_id % 11 = 0 then '' when d.doc_id % 13 = 0 then null
              else cast(date '2024-01-01' + cast(d.doc_id % 60 as int) as varchar)
                   || case when d.doc_id % 6 = 5 then 'T10:00:00' else '' end end as date_posted,
         timestamp '2024-01-01 06:00:00' + cast(d.doc_id % 30 as int) * interval '1' day as discovered_at,
         case when d.doc_id % 17 = 0 then true when d.doc_id % 19 = 0 then null else false end as hidden,
         cast(case when l.toxic = 1 then -1 when l.quality = 1 then 1 end as int) as user_rating,
         d.doc_id as arrival
  from documents d left join labels l on l.doc_id = d.doc_id
  join nation n on n.n_nationkey = d.doc_id % 25)"""

BOARD_JOBS = LISTINGS_RAW + """,
board_jobs as (
  select * exclude (rn), cast(0 as bigint) as profile_id
  from (select *, row_number() over (partition by job_url order by arrival) as rn from listings_raw)
  where rn = 1)"""


def board_ledger(as_of: str, days_before: int = 7) -> str:
    return f""",
board_ledger as (
  select cast(0 as bigint) as profile_id, j.job_url, min(e.ts) as sent_at
  from events e join board_jobs j on j.id = cast(json_extract_string(e.props, '$.k') as bigint)
  where e.event_type = 'view' and e.ts < timestamp '{as_of}' - interval {days_before} day
  group by j.job_url)"""


FEEDBACK_EVENTS = """
feedback_events as (
  select user_id as profile_id,
         cast(json_extract_string(props, '$.k') as bigint) as listing_id,
         event_id as seq, ts,
         case when event_type in ('purchase', 'error') then 'rate' when event_type = 'click' then 'applied'
              when event_type = 'view' then 'note' when event_type = 'signup' then 'hide' end as kind,
         case when event_type = 'purchase' then (case when value > 48 then '2' else '1' end)
              when event_type = 'error' then (case when value < 3 then '0' else '-1' end)
              when event_type = 'view' then (case when value < 2 then '' else concat('note ', cast(event_id as varchar)) end)
              when event_type = 'signup' then (case when value >= 20 then '1' else '0' end)
              when event_type = 'click' then (case when value >= 10 then '1' else '0' end)
              else '1' end as value
  from events)"""

def _segment_keywords_sql() -> str:
    from rankloom.sources.listings import SEGMENT_KEYWORDS
    rows = ", ".join(f"({i}, '{a}', '{b}', '{c}', cast({w} as double))" for i, (a, b, c, w) in enumerate(SEGMENT_KEYWORDS))
    return f"""
segment_keywords(ord, segment, kind, keyword, weight) as (values {rows})"""


SEGMENT_KEYWORDS_SQL = _segment_keywords_sql()

PROFILES_FLAT = """
profiles_flat as (
  select c.c_custkey as profile_id, c.c_mktsegment as segment, n.n_name as nation_name, r.r_name as region_name,
         cast(floor(greatest(c.c_acctbal, 0.0) / 200) as int) as score_threshold,
         5 as max_jobs_per_email, 7 as max_job_age_days, 30 as rerank_candidates, case when c.c_custkey % 3 = 0 then 0.5 else 0.3 end as rerank_min_score
  from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey)"""

FLEET_JOBS = """
fleet_jobs as (
  select o.o_custkey as profile_id,
         concat_ws('/', 'https://t.example', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) as job_url,
         p.p_name as title, s.s_name as employer, n.n_name as location,
         concat_ws(' ', p.p_type, p.p_name, p.p_brand) as description,
         cast((l.l_partkey * 7 + l.l_suppkey * 13 + l.l_linenumber) % 101 as int) as score,
         (l.l_linestatus = 'O') as is_remote,
         replace(lower(substr(o.o_orderpriority, 3)), ' ', '-') as job_type,
         case when l.l_returnflag = 'R' then 'nan' else cast(cast(l.l_shipdate as date) as varchar) end as date_posted,
         o.o_orderdate as discovered_at, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join part p on l.l_partkey = p.p_partkey
  join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey
  qualify row_number() over (partition by job_url order by l.l_shipdate, l.l_linestatus, l.l_returnflag) = 1)"""

FLEET_LEDGER = """
fleet_ledger as (
  select o.o_custkey as profile_id,
         concat_ws('/', 'https://t.example', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) as job_url,
         o.o_orderdate as sent_at
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  where l.l_returnflag = 'A')"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip().lstrip(",").strip() for c in ctes)

RAW_FETCH = LISTINGS_RAW + """,
raw_fetch as (
  select r.id, r.arrival, r.employer as site, r.language as term, r.location as search_location,
         r.title, r.employer as company, r.location, r.job_url, r.date_posted,
         case when l.doc_id is not null then r.is_remote end as is_remote,
         nullif(r.job_type, '') as job_type, r.description, r.discovered_at
  from listings_raw r left join labels l on l.doc_id = r.id)"""


def tokens_sql(text: str) -> str:
    cleaned = f"trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g'))"
    return f"(case when {cleaned} = '' then []::varchar[] else string_split({cleaned}, ' ') end)"


def language_ctes(source: str) -> str:
    """The n-gram language model of ``documents`` and ``detected(id, detected_language)``
    for the CTE or table ``source(id, text)``."""
    def grams(keys, rows):
        return (f"select {keys}, substr(p, i, 3) as g from ("
                f"select {keys}, ' ' || w || ' ' as p, unnest(range(1, length(w) + 1)) as i from ("
                f"select {keys}, unnest(list_distinct({tokens_sql('text')})) as w from {rows}))")
    return f"""
lm_sample as (
  select doc_id, lang from (select distinct doc_id, lang from documents where lang is not null and doc_id is not null)
  qualify row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) <= {LG.SAMPLE_PER_LANGUAGE}),
lm_count as (
  select lang, g, count(*) as n from (
    {grams("lang", "(select s.lang, d.text from documents d join lm_sample s on s.doc_id = d.doc_id)")})
  group by lang, g),
lm_top as (select g from lm_count group by g order by sum(n) desc, g limit {LG.MAX_GRAMS}),
lm_total as (select lang, sum(n) as total from lm_count semi join lm_top using (g) group by lang),
lm as (
  select t.g, l.lang, cast(round(1000 * ln((coalesce(c.n, 0) + 1) / (l.total + (select count(*) from lm_top)))) as bigint) as w
  from lm_top t cross join lm_total l left join lm_count c on c.g = t.g and c.lang = l.lang),
detected as (
  select id, lang as detected_language from (
    select id, lang, sum(w) as s from ({grams("id", source)}) join lm using (g) group by id, lang)
  qualify row_number() over (partition by id order by s desc, lang) = 1)"""


def fold_sql(name: str, where: str = "true", keys: str = "profile_id, listing_id") -> str:
    """Feedback fold per key (default (profile_id, listing_id)) over ``feedback_events``."""
    key = "{'ts': ts, 'seq': seq}"
    ok = "try_cast(value as int) in (-1, 0, 1)"
    return f"""
{name} as (
  select {keys},
    nullif(cast(arg_max(value, {key}) filter (where kind = 'rate' and {ok}) as int), 0) as user_rating,
    nullif(arg_max(value, {key}) filter (where kind = 'note'), '') as notes,
    coalesce(arg_max(value, {key}) filter (where kind = 'applied') = '1', false) as is_applied,
    (arg_max(value, {key}) filter (where kind = 'hide')) = '1' as hidden,
    coalesce(bool_or(kind = 'rate' and {ok}), false) as has_rating,
    coalesce(bool_or(kind = 'note'), false) as has_note
  from feedback_events where {where} group by {keys})"""


STATE_ROWS = """
state_rows as (
  select f.profile_id, j.job_url, j.title, j.employer, j.score, j.is_remote, j.job_type, j.discovered_at,
         f.user_rating, f.notes, coalesce(f.hidden, j.hidden) as hidden, f.is_applied
  from fold f join board_jobs j on j.id = f.listing_id)"""

FEEDBACK_LINE_SQL = ("concat(coalesce(title, ''), ' at ', coalesce(employer, ''), ' (score ', "
                     "coalesce(cast(score as varchar), '?'), ')', "
                     "case when coalesce(is_remote, false) then ', Remote' else '' end, "
                     "case when coalesce(job_type, '') <> '' then ', ' || job_type else '' end, "
                     "case when coalesce(notes, '') <> '' then '. Note: ' || notes else '' end)")
