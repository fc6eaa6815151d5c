"""Ingest queries: search fan-out, scan cap, normalisation, dedup, pre-filters, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import ingest as I
from rankloom.operators import digest as D
from rankloom.operators import filters as B
from rankloom.operators import language as LG
from rankloom.operators import relevance as R
from rankloom.operators import scoring as S
from rankloom.plans import oracle_views as V
from rankloom.plans.digest import BOARD_AS_OF
from rankloom.plans.registry import query
from rankloom.plans.scoring import BOARD_BOOST, BOARD_PENALTY, relevance_ctes
from rankloom.session import materialize
from rankloom.sources import listings as L
from rankloom.sources.pages import page_fields
from rankloom.sources.tables import read

# Board ingest parameters: rows discovered before the cutoff were stored by
# earlier runs; the rest is the current batch.
KNOWN_BEFORE = "2024-01-15 00:00:00"
BOARD_REGIONS = ["NATION_1", "nation_2"]
BOARD_LANGUAGE = "en"
SCAN_HOURS_OLD = 240
SCAN_RESULTS = 25
DIGEST_MIN_SCORE = 10  # term relevance runs lower than a model's marks


def _batch(spark, sf_dir):
    return I.normalize(L.raw_fetch(spark, sf_dir)).filter(F.col("discovered_at") >= F.lit(KNOWN_BEFORE).cast("timestamp"))


def _known(spark, sf_dir):
    return L.board_jobs(spark, sf_dir).filter(F.col("discovered_at") < F.lit(KNOWN_BEFORE).cast("timestamp"))


@query("search_tasks", "A1", V.with_(V.PROFILES_FLAT) + """
select profile_id, 0 as term_pos, lower(segment) as term, 0 as location_pos, nation_name as location,
       25 as results_wanted, 24 as hours_old from profiles_flat
union all
select profile_id, 0, lower(segment), 1, region_name, 25, 24 from profiles_flat""")
def search_tasks(spark, sf_dir):
    return I.search_tasks(L.profiles(spark, sf_dir))


@query("scan_cap", "A2", V.with_(V.RAW_FETCH) + f"""
select id, site, term, fetch_rank, job_url from (
  select *, row_number() over (partition by site, term order by arrival) as fetch_rank from raw_fetch
  where discovered_at >= timestamp '{BOARD_AS_OF}' - interval {SCAN_HOURS_OLD} hour)
where fetch_rank <= {SCAN_RESULTS}""")
def scan_cap(spark, sf_dir):
    x = I.scan_cap(L.raw_fetch(spark, sf_dir), ["site", "term"], SCAN_RESULTS, BOARD_AS_OF, SCAN_HOURS_OLD)
    return x.select("id", "site", "term", F.col("fetch_rank").cast("bigint").alias("fetch_rank"), "job_url")


@query("normalize_listings", "A3", V.with_(V.RAW_FETCH) + """
select id, coalesce(title, 'nan') as title, coalesce(company, 'nan') as employer,
       coalesce(location, 'nan') as location, coalesce(date_posted, 'nan') as date_posted,
       coalesce(job_type, 'nan') as job_type, coalesce(is_remote, true) as is_remote
from raw_fetch""")
def normalize_listings(spark, sf_dir):
    x = I.normalize(L.raw_fetch(spark, sf_dir), parity=True)
    return x.select("id", "title", "employer", "location", "date_posted", "job_type", "is_remote")


_SQL_DECODE = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def _sq(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


PAGE_SQL = f"""
with p as (
  select page_id, url,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as site,
    lower(regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1)) as lang,
    {_sq(_SQL_DECODE.format(x="regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} as title,
    {_sq(_SQL_DECODE.format(x="regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))} as text
  from pages)
select page_id, url, site, lang, title, text, len({V.tokens_sql('text')}) as n_words from p"""


@query("page_listings", "A11", PAGE_SQL)
def page_listings(spark, sf_dir):
    return page_fields(read(spark, sf_dir, "pages"))


@query("ingest_first_arrival", "E1 B3", V.with_(V.RAW_FETCH) + """
select id, job_url from (
  select *, row_number() over (partition by job_url order by arrival) as rn from raw_fetch
  where job_url is not null and job_url <> '')
where rn = 1""")
def ingest_first_arrival(spark, sf_dir):
    return I.first_arrival(I.normalize(L.raw_fetch(spark, sf_dir))).select("id", "job_url")


_BATCH_KNOWN_SQL = V.with_(V.BOARD_JOBS, V.RAW_FETCH.replace(V.LISTINGS_RAW + ",", ""), f"""
batch as (select * from raw_fetch where discovered_at >= timestamp '{KNOWN_BEFORE}'),
known as (select job_url from board_jobs where discovered_at < timestamp '{KNOWN_BEFORE}')""")


@query("ingest_new_only", "C1", _BATCH_KNOWN_SQL + """
select id, job_url from (
  select *, row_number() over (partition by job_url order by arrival) as rn from batch
  where job_url is not null and job_url <> '') b
where rn = 1 and not exists (select 1 from known k where k.job_url = b.job_url)""")
def ingest_new_only(spark, sf_dir):
    return I.new_only(_batch(spark, sf_dir), _known(spark, sf_dir)).select("id", "job_url")


@query("ingest_region", "B1 H1", V.with_(V.FLEET_JOBS, V.PROFILES_FLAT) + """
select j.profile_id, j.job_url from fleet_jobs j join profiles_flat p on p.profile_id = j.profile_id
where j.is_remote or contains(lower(j.location), lower(p.nation_name))""")
def ingest_region(spark, sf_dir):
    p = L.profiles(spark, sf_dir).select("profile_id", F.col("search.allowed_regions").alias("allowed_regions"))
    x = L.fleet_jobs(spark, sf_dir).join(p, "profile_id")
    return x.filter(B.region_ok("location", "is_remote", "allowed_regions")).select("profile_id", "job_url")


_FETCHED_TEXT = "(select id, concat_ws(' ', coalesce(title, ''), coalesce(description, '')) as text from {})"


def language_model(spark, sf_dir):
    """What the landed documents' own language labels teach (a bounded sample of them)."""
    return LG.learn(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query("ingest_language", "B2 J9", V.with_(V.RAW_FETCH, V.language_ctes(_FETCHED_TEXT.format("raw_fetch"))) + """
, d as (select l.id, x.detected_language as detected, l.language from listings_raw l left join detected x on x.id = l.id)
select id, detected, language as labelled,
       (detected is null or lower(detected) = 'en') as passed from d""")
def ingest_language(spark, sf_dir):
    x = I.normalize(L.raw_fetch(spark, sf_dir)).withColumnRenamed("term", "labelled")  # the task asked by language
    det = LG.detect(x, "id", F.concat_ws(" ", "title", "description"), language_model(spark, sf_dir))
    x = x.join(det, "id", "left").withColumnRenamed("detected_language", "detected")
    return x.select("id", "detected", "labelled", B.language_ok("detected", F.lit(BOARD_LANGUAGE)).alias("passed"))


@query("eval_language", "J9", "with " + V.language_ctes("(select doc_id as id, text from documents)").strip() + """
select d.lang, count(*) as n, cast(count_if(x.detected_language = d.lang) as bigint) as n_right,
       cast(count_if(x.detected_language is null) as bigint) as n_unknown,
       count_if(x.detected_language = d.lang) >= 0.98 * count(*) as passed
from documents d left join detected x on x.id = d.doc_id
where d.lang is not null and d.doc_id not in (select doc_id from lm_sample) group by d.lang""")
def eval_language(spark, sf_dir):
    """The language model against the labels of all rows that it has not learnt from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = docs.where("lang is not null").join(LG.learning_sample(docs, "doc_id", "lang"), "doc_id", "left_anti")
    x = rest.select("doc_id", "lang").join(LG.detect(rest, "doc_id", "text", language_model(spark, sf_dir)), "doc_id", "left")
    right = F.col("detected_language") == F.col("lang")
    return x.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.count_if(F.col("detected_language").isNull()).alias("n_unknown"),
        (F.count_if(right) >= 0.98 * F.count("*")).alias("passed"))


def _decided(spark, sf_dir, detect_all=False):
    return I.decide(_batch(spark, sf_dir), _known(spark, sf_dir), BOARD_REGIONS, BOARD_LANGUAGE,
                    language_model(spark, sf_dir), detect_all=detect_all)


def decided_ctes() -> str:
    """CTEs from ``batch`` and ``known`` to ``decided``."""
    return f""",
firsts as (select job_url, min(arrival) as first_arrival from batch
           where job_url is not null and job_url <> '' group by job_url),
{V.language_ctes(_FETCHED_TEXT.format("batch")).strip()},
dec0 as (
  select b.*, f.first_arrival, (k.job_url is not null) as is_known, x.detected_language
  from batch b left join firsts f on f.job_url = b.job_url left join detected x on x.id = b.id
  left join (select distinct job_url from known) k on k.job_url = b.job_url),
decided as (
  select *, case
    when job_url is null or job_url = '' then 'no_url'
    when arrival > first_arrival then 'duplicate'
    when is_known then 'known'
    when not (coalesce(is_remote, false) or contains(lower(coalesce(location, '')), 'nation_1')
              or contains(lower(coalesce(location, '')), 'nation_2')) then 'skipped_region'
    when not (detected_language is null or lower(detected_language) = 'en') then 'skipped_language'
    else 'new' end as decision
  from dec0)"""


_DECIDED_SQL = _BATCH_KNOWN_SQL + decided_ctes()


@query("ingest_counters", "D5", _DECIDED_SQL + """
select count(*) as n_rows,
  cast(count_if(decision = 'new') as bigint) as n_new,
  cast(count_if(decision = 'skipped_region') as bigint) as n_skipped_region,
  cast(count_if(decision = 'skipped_language') as bigint) as n_skipped_language,
  cast(count_if(decision = 'known') as bigint) as n_known,
  cast(count_if(decision = 'duplicate') as bigint) as n_duplicate,
  cast(count_if(decision = 'no_url') as bigint) as n_no_url
from decided""")
def ingest_counters(spark, sf_dir):
    return I.counters(_decided(spark, sf_dir))


@query("ingest_cube", "D15", _DECIDED_SQL + """
select site, detected_language, cast(grouping(site, detected_language) as int) as gid,
       count(*) as n_rows, cast(count_if(decision = 'new') as bigint) as n_new
from decided group by cube (site, detected_language)""")
def ingest_cube(spark, sf_dir):
    return (_decided(spark, sf_dir, detect_all=True).cube("site", "detected_language")
            .agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n_rows"),
                 F.count_if(F.col("decision") == "new").alias("n_new")))


# Every benchmark text is the resume of a profile of the scored ingest, whose users
# share the board's keywords.
SCORED_CTES = ",\n" + relevance_ctes(False).strip() + f""",
scored as (
  select r.item_id as profile_id, d.id, d.arrival, d.job_url, d.title, d.company as employer, d.location, d.is_remote, d.job_type, d.date_posted,
         d.discovered_at, r.score as raw_score,
         greatest(-20.0, least(20.0, cast({" + ".join(f"(case when contains(lower(d.description), '{k}') then {w} else 0 end)" for k, w in BOARD_BOOST + BOARD_PENALTY)} as double))) as delta
  from decided d join rel r on r.doc_id = d.id where d.decision = 'new'),
jobs as (select *, greatest(0.0, least(100.0, raw_score + delta)) as score from scored)"""
INGEST_SCORED_SQL = _DECIDED_SQL + SCORED_CTES


def scored_jobs(spark, sf_dir):
    """A fetched batch all the way to the ``jobs`` rows of every profile: normalised,
    first arrivals, unknown, in region, in language; scored by term relevance to
    each profile's resume (J5) plus the keyword weights (D8). Only rows that
    passed are scored, and a profile's jobs are those of a relevance of
    ``MIN_SCORE`` or more: all profiles with all rows would be a cross join."""
    return score_new(spark, sf_dir, materialize(_decided(spark, sf_dir).filter(F.col("decision") == "new"), "ingest-new"))


def score_new(spark, sf_dir, new):
    """The ``jobs`` rows that new listings give: every profile whose resume they are relevant to."""
    def kw(items):
        return F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for k, w in items])

    # the keywords are the board's, so a listing has one delta and its text does not travel once per profile
    rows = new.withColumn("delta", S.keyword_delta("description", kw(BOARD_BOOST), kw(BOARD_PENALTY))).drop("description")
    rel = R.relevance(spark, read(spark, sf_dir, "benchmark"), "item_id", "text", read(spark, sf_dir, "documents"),
                      "doc_id", "text", only=new.select(F.col("id").alias("doc_id")))
    rel = rel.select(F.col("item_id").alias("profile_id"), F.col("doc_id").alias("id"), F.col("score").alias("raw_score"))
    return rows.join(rel, "id").withColumn("score", S.adjust("raw_score", F.col("delta")))


@query("ingest_scored", "K1 A6 J5 D8", INGEST_SCORED_SQL + """
select profile_id, id, job_url, title, employer, raw_score, delta, score from jobs""")
def ingest_scored(spark, sf_dir):
    return scored_jobs(spark, sf_dir).select("profile_id", "id", "job_url", "title", "employer", "raw_score", "delta", "score")


@query("digest_scored", "B4 B7 C2 E3 F1", INGEST_SCORED_SQL + V.board_ledger(BOARD_AS_OF) + f""",
fresh as (
  select *, row_number() over (partition by profile_id order by score desc, job_url) as pos from jobs j
  where not exists (select 1 from board_ledger l where l.profile_id = j.profile_id and l.job_url = j.job_url) and score >= {DIGEST_MIN_SCORE}
    and case when coalesce(date_posted, '') not in ('nan', '')
             then try_cast(left(date_posted, 10) as date) >= cast(timestamp '{BOARD_AS_OF}' as date) - 14
             else cast(discovered_at as date) >= cast(timestamp '{BOARD_AS_OF}' as date) - 7 end)
select profile_id, pos, job_url, score from fresh where pos <= 5""")
def digest_scored(spark, sf_dir):
    """Today's digest, for every profile, of the rows that the scored ingest has just stored."""
    jobs = scored_jobs(spark, sf_dir)
    ledger = L.board_sent_ledger(spark, sf_dir, BOARD_AS_OF)
    cands = D.candidates(D.with_settings(jobs, score_threshold=DIGEST_MIN_SCORE), ledger, BOARD_AS_OF)
    return D.top_by_score(cands, F.col("max_jobs_per_email")).select("profile_id", "pos", "job_url", "score")


@query("ingest_quality_gate", "B17", f"""
with q as (
  select d.doc_id, cast(l.quality as double) as quality,
    len({V.tokens_sql('d.text')}) as n_words,
    len(string_split(d.text, chr(10))) as n_lines,
    round(1.0 - len(list_distinct(string_split(d.text, chr(10)))) / len(string_split(d.text, chr(10))), 4) as dup_line_share,
    round(case when length(d.text) > 0 then length(regexp_replace(d.text, '[^\\p{{L}}]', '', 'g')) / length(d.text) else 0.0 end, 4) as letter_share
  from documents d left join labels l on l.doc_id = d.doc_id)
select *, (n_words >= {I.QUALITY_MIN_WORDS} and dup_line_share <= {I.QUALITY_MAX_DUP_SHARE}
           and letter_share >= {I.QUALITY_MIN_LETTER_SHARE}) as passed from q""")
def ingest_quality_gate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    x = d.join(lab, "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("quality"),
                                             *I.quality_rules("text"))
    return x.withColumn("passed", I.quality_pass())
