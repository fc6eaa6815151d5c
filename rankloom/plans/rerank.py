"""Re-ranking queries: vector and term rerankers, positional answers A/B, fallback chain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import digest as D
from rankloom.operators import relevance as R
from rankloom.operators import rerank as RR
from rankloom.operators.ranking import top_n_per_group
from rankloom.plans.digest import BOARD_CAND_SQL, FLEET_CAND_SQL, board_candidates, fleet_candidates, most_of
from rankloom.plans.registry import query
from rankloom.session import materialize
from rankloom.plans.scoring import relevance_ctes, with_feedback
from rankloom.sources import listings as L
from rankloom.sources.tables import read

A_SEGMENTS = ("AUTOMOBILE", "BUILDING")
B_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD")
BOARD_RERANK_MIN = 0.1  # the board profile's own rerank_min_score setting


def board_cut(spark, sf_dir):
    """The board's first candidates in score order."""
    cands = board_candidates(spark, sf_dir).withColumn("rerank_min_score", F.lit(BOARD_RERANK_MIN))
    return RR.candidate_index(D.top_by_score(cands, F.col("rerank_candidates")))


def numbered(rows, keys, order):
    """``pos`` by ``order``; a group is one profile's cut or one answer to it."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


BOARD_CUT_SQL = BOARD_CAND_SQL + """,
board_cut as (select *, cast(pos - 1 as int) as idx from
  (select *, row_number() over (partition by profile_id order by score desc, job_url) as pos from board_cand)
  where pos <= 30)"""


@query("rerank_vectors", "J6 B14", BOARD_CUT_SQL + """,
liked as (select j.profile_id, e.embedding from board_jobs j join embeddings e on e.vec_id = j.id where j.user_rating = 1),
cent0 as (select profile_id, i, avg(cast(x as double)) as x from
          (select profile_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from liked) group by all),
cent as (select profile_id, list(x order by i) as centroid from cent0 group by profile_id),
scored as (select c.profile_id, c.pos as score_pos, c.job_url,
                  coalesce(list_cosine_similarity(t.centroid, cast(e.embedding as double[])), 0.0) as relevance
           from board_cut c left join embeddings e on e.vec_id = c.id left join cent t on t.profile_id = c.profile_id)
select profile_id, row_number() over (partition by profile_id order by relevance desc, score_pos) as pos,
       job_url, round(relevance, 6) as relevance
from scored where relevance >= 0.1""")
def rerank_vectors(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    liked = (L.board_jobs(spark, sf_dir).filter(F.col("user_rating") == 1)
             .join(emb, F.col("id") == F.col("vec_id")).select("profile_id", "embedding"))
    cut = board_cut(spark, sf_dir)
    vecs = cut.join(emb, F.col("id") == F.col("vec_id")).select("profile_id", "job_url", "embedding")
    cos = RR.cosine_to_centroid(vecs, "job_url", "embedding", liked)
    scored = cut.join(cos, ["profile_id", "job_url"], "left").select(
        "profile_id", F.col("pos").alias("score_pos"), "job_url", "rerank_min_score",
        F.coalesce("cosine", F.lit(0.0)).alias("relevance"))
    kept = scored.filter(F.col("relevance") >= F.col("rerank_min_score"))
    out = numbered(kept, ["profile_id"], [F.col("relevance").desc(), F.col("score_pos")])
    return out.select("profile_id", "pos", "job_url",
                      F.round("relevance", 6).alias("relevance"))


@query("rerank_terms", "J6 J5 B14", BOARD_CUT_SQL + ",\n" + relevance_ctes(False, bar="score >= 10").strip() + """,
scored as (select r.item_id, c.pos as score_pos, c.job_url, r.score / 100.0 as relevance
           from rel r join board_cut c on c.id = r.doc_id)
select item_id, row_number() over (partition by item_id order by relevance desc, score_pos) as pos,
       job_url, relevance from scored where relevance >= 0.1""")
def rerank_terms(spark, sf_dir):
    cut = board_cut(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("pos").alias("score_pos"), "job_url")
    rel = R.relevance(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                      read(spark, sf_dir, "documents"), "doc_id", "text",
                      min_score=round(100 * BOARD_RERANK_MIN), only=cut)
    scored = rel.join(cut, "doc_id").select("item_id", "score_pos", "job_url",
                                             (F.col("score") / 100.0).alias("relevance"))
    out = numbered(scored, ["item_id"], [F.col("relevance").desc(), F.col("score_pos")])
    return out.select("item_id", "pos", "job_url", "relevance")


# --------------------------------------------------------------------------- fleet answers

def fleet_cut(spark, sf_dir):
    """E2 cut of every fleet profile (``rerank_candidates`` rows each)."""
    return RR.candidate_index(D.top_by_score(fleet_candidates(spark, sf_dir), F.col("rerank_candidates"),
                                             most=most_of(spark, sf_dir, "rerank_candidates")))


def stored_cut(spark, sf_dir):
    """The cut as a table: the answers, the positional joins and the fallback all read it."""
    return materialize(fleet_cut(spark, sf_dir))


def _segments(spark, sf_dir):
    return L.profiles(spark, sf_dir).select("profile_id", "segment")


def answers_a(spark, sf_dir, cut):
    """Reranker A's answers as landed: (profile, answer position, index, relevance).
    Relevance comes from the part; some are missing; some indexes are negative.
    Answers of some profiles are empty, and some hold an index that is null or
    beyond the list."""
    x = cut.join(_segments(spark, sf_dir), "profile_id").filter(F.col("segment").isin(*A_SEGMENTS))
    rel = F.when(F.col("l_partkey") % 10 == 9, F.lit(None).cast("double")).otherwise((F.col("l_partkey") % 10) / 10)
    w = Window.partitionBy("profile_id")
    x = x.withColumn("rel", rel).withColumn("_n", F.count("*").over(w))
    x = x.withColumn("resp_pos", F.row_number().over(
        w.orderBy(F.coalesce(F.col("rel"), F.lit(0.0)).desc(), F.col("idx"))) - 1)
    first, who = F.col("resp_pos") == 0, F.col("profile_id") % 11
    index = (F.when(first & (who == 5), F.col("_n")).when(first & (who == 7), F.lit(None))
             .when(F.col("l_suppkey") % 7 == 0, F.col("idx") - F.col("_n")).otherwise(F.col("idx")))
    return x.filter(who != 3).select("profile_id", "resp_pos", index.cast("bigint").alias("index"),
                                     F.col("rel").alias("relevance_score"))


def asked_a(spark, sf_dir, cut):
    """Profiles that reranker A answered, with an empty list or not."""
    asked = _segments(spark, sf_dir).filter(F.col("segment").isin(*A_SEGMENTS)).select("profile_id")
    return asked.join(cut, "profile_id", "left_semi")


def usable_a(spark, sf_dir, cut, answers):
    """Profiles with an answer of A that holds; a bad index spoils its own profile's only."""
    spoilt = answers.select("profile_id").distinct().join(RR.usable_a(cut, answers), "profile_id", "left_anti")
    return asked_a(spark, sf_dir, cut).join(spoilt, "profile_id", "left_anti")


def answers_b(spark, sf_dir, cut):
    """Reranker B's answers as landed: parallel arrays, one out-of-range index at
    the end, and scores only for the first half of the list."""
    x = cut.join(_segments(spark, sf_dir), "profile_id").filter(F.col("segment").isin(*B_SEGMENTS))
    x = x.withColumn("rel", (F.col("l_partkey") % 10) / 10)
    g = x.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("rel")).alias("k"), F.col("idx").alias("idx"), F.col("rel").alias("rel")))).alias("s"),
        F.count("*").alias("n"))
    return g.select("profile_id",
                    F.concat(F.transform("s", lambda e: e["idx"]), F.array(F.col("n").cast("int"))).alias("ranked"),
                    F.slice(F.transform("s", lambda e: e["rel"]), 1, F.ceil(F.col("n") / 2).cast("int")).alias("scores"))


FLEET_CUT_SQL = FLEET_CAND_SQL + ",\n" + """
fleet_cut as (select *, cast(pos - 1 as int) as idx from
  (select *, row_number() over (partition by profile_id order by score desc, job_url) as pos from fleet_cand)
  where pos <= rerank_candidates),
ans_a0 as (select c.*, case when c.l_partkey % 10 = 9 then null else (c.l_partkey % 10) / 10 end as rel,
                  count(*) over (partition by c.profile_id) as n
           from fleet_cut c join profiles_flat p on p.profile_id = c.profile_id
           where p.segment in ('AUTOMOBILE', 'BUILDING')),
asked as (select distinct profile_id from ans_a0),
spoilt as (select distinct profile_id from ans_a0 where profile_id % 11 in (5, 7)),
ans_a as (select profile_id, idx, job_url, rel,
                 row_number() over (partition by profile_id order by coalesce(rel, 0.0) desc, idx) - 1 as resp_pos
                 , rerank_min_score
          from ans_a0 where profile_id % 11 <> 3),
a_rows as (select profile_id, resp_pos as order_key, job_url, coalesce(rel, 0.0) as relevance from ans_a
           where coalesce(rel, 0.0) >= rerank_min_score and profile_id not in (select profile_id from spoilt)),
ans_b0 as (select c.*, (c.l_partkey % 10) / 10 as rel, count(*) over (partition by c.profile_id) as n,
                  row_number() over (partition by c.profile_id order by -((c.l_partkey % 10) / 10), c.idx) - 1 as resp_pos
           from fleet_cut c join profiles_flat p on p.profile_id = c.profile_id
           where p.segment in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')),
b_rows as (select profile_id, resp_pos as order_key, job_url,
                  case when resp_pos < ceil(n / 2) then rel else 1.0 end as relevance
           from ans_b0 where (case when resp_pos < ceil(n / 2) then rel else 1.0 end) >= rerank_min_score)"""


@query("rerank_positional_a", "C7 B14", FLEET_CUT_SQL + """
select profile_id, row_number() over (partition by profile_id order by order_key) as pos, job_url, relevance
from a_rows""")
def rerank_positional_a(spark, sf_dir):
    cut = stored_cut(spark, sf_dir)
    out = numbered(RR.positional_a(cut, answers_a(spark, sf_dir, cut)), ["profile_id"], ["order_key"])
    return out.select("profile_id", "pos", "job_url", "relevance")


@query("rerank_positional_b", "C7 J7 B14", FLEET_CUT_SQL + """
select profile_id, row_number() over (partition by profile_id order by order_key) as pos, job_url, relevance
from b_rows""")
def rerank_positional_b(spark, sf_dir):
    cut = stored_cut(spark, sf_dir)
    out = numbered(RR.positional_b(cut, answers_b(spark, sf_dir, cut)), ["profile_id"], ["order_key"])
    return out.select("profile_id", "pos", "job_url", "relevance")


RERANKED_SQL = FLEET_CUT_SQL + """,
rows_ as (select profile_id, order_key, job_url, 1 as priority from a_rows
          union all select profile_id, order_key, job_url, 2 from b_rows
          union all select profile_id, idx, job_url, 3 from fleet_cut),
markers as (select profile_id, 1 as priority from asked where profile_id not in (select profile_id from spoilt)
            union all select distinct profile_id, 2 from b_rows
            union all select distinct profile_id, 3 from fleet_cut),
chosen as (select profile_id, min(priority) as priority from markers group by profile_id),
picked as (select r.*, case r.priority when 1 then 'A' when 2 then 'B' else 'score' end as source
           from rows_ r join chosen c on c.profile_id = r.profile_id and c.priority = r.priority),
reranked as (select profile_id, pos, job_url, source from
  (select *, row_number() over (partition by profile_id order by order_key, job_url) as pos from picked)
  where pos <= 5)"""


def reranked(spark, sf_dir):
    """``(rows to send, stored cut)``: the fallback chain over every profile's cut, then E3."""
    cut = stored_cut(spark, sf_dir)
    a_ans = answers_a(spark, sf_dir, cut)
    a_rows = RR.positional_a(cut, a_ans)
    b_rows = RR.positional_b(cut, answers_b(spark, sf_dir, cut))
    score_rows = cut.select("profile_id", F.col("idx").alias("order_key"), "job_url")
    picked = RR.fallback(score_rows, a_rows, usable_a(spark, sf_dir, cut, a_ans), b_rows)
    limit = L.profiles(spark, sf_dir).select(
        "profile_id", F.coalesce("notification.max_jobs_per_email", F.lit(D.DIGEST_DEFAULTS["max_jobs_per_email"])).alias("n"))
    top = top_n_per_group(picked.join(limit, "profile_id"), ["profile_id"], [F.col("order_key"), F.col("job_url")],
                          F.col("n"), rank_col="pos", most=most_of(spark, sf_dir, "max_jobs_per_email"))
    return top.select("profile_id", F.col("pos").cast("bigint").alias("pos"), "job_url", "source"), cut


@query("rerank_fallback", "F6 E3", RERANKED_SQL + """
select profile_id, pos, job_url, source from reranked""")
def rerank_fallback(spark, sf_dir):
    return reranked(spark, sf_dir)[0]


def _requests_sql():
    from rankloom.plans.feedback import FEEDBACK_SUMMARY_SQL
    return FLEET_CUT_SQL + f""",
fb as ({FEEDBACK_SUMMARY_SQL})"""


@query("rerank_requests", "J6 J7 J10 H20 H21", _requests_sql() + """
select f.profile_id, idx, concat_ws(chr(10), concat('Buyer in ', lower(p.segment)), c.c_name, fb.summary) as query,
  concat(coalesce(title, ''), ' at ', coalesce(employer, ''), ' (', coalesce(location, ''), ')', chr(10),
         coalesce(nullif(description, ''), 'model score ' || cast(score as varchar), '')) as document,
  concat(cast(idx as varchar), '. ', coalesce(title, ''), ' at ', coalesce(employer, ''), ' (',
         coalesce(location, ''), '): ', coalesce(nullif(description, ''), 'model score ' || cast(score as varchar), '')) as line
from fleet_cut f join profiles_flat p on p.profile_id = f.profile_id join customer c on c.c_custkey = f.profile_id
left join fb on fb.profile_id = f.profile_id""")
def rerank_requests(spark, sf_dir):
    """What a reranker is sent for each profile's cut: the profile with its
    feedback summary as the query, one document per candidate (A) and one
    numbered line per candidate (B)."""
    cut = L.fleet_details(spark, sf_dir, fleet_cut(spark, sf_dir)).withColumn("reason", F.concat(F.lit("model score "), F.col("score").cast("string")))
    who = with_feedback(spark, sf_dir, L.profiles(spark, sf_dir)).select(
        "profile_id", F.concat_ws("\n", "resume", F.col("description"), "feedback_summary").alias("query"))
    cut = cut.join(who, "profile_id")
    return cut.select("profile_id", "idx", "query", RR.rerank_document().alias("document"), RR.rerank_line().alias("line"))


LIST_TASK = "Rank these listings for the candidate, best first. Leave out what does not fit."
LIST_ANSWER = 'Answer as JSON: {"ranked": [<numbers>], "scores": [<0 to 1>]}'

_LIST_SQL = "with " + _requests_sql().strip().removeprefix("with ") + f""",
line as (
  select f.profile_id, idx, concat_ws(chr(10), concat('Buyer in ', lower(p.segment)), c.c_name, fb.summary) as query,
    concat(cast(idx as varchar), '. ', coalesce(title, ''), ' at ', coalesce(employer, ''), ' (', coalesce(location, ''), '): ',
           coalesce(nullif(description, ''), 'model score ' || cast(score as varchar), '')) as line
  from fleet_cut f join profiles_flat p on p.profile_id = f.profile_id join customer c on c.c_custkey = f.profile_id
  left join fb on fb.profile_id = f.profile_id)
select profile_id, count(*) as n_listings,
       concat_ws(chr(10), '{LIST_TASK}', 'CANDIDATE: ' || any_value(query), string_agg(line, chr(10) order by idx), '{LIST_ANSWER}') as request
from line group by profile_id"""


@query("rerank_list_requests", "J7 H21", _LIST_SQL)
def rerank_list_requests(spark, sf_dir):
    """Reranker B's request: one list per profile, its cut (at most ``rerank_candidates`` lines) in order."""
    x = rerank_requests(spark, sf_dir)
    g = x.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("lines"), F.first("query").alias("query"),
                                    F.count("*").alias("n_listings"))
    return g.select("profile_id", "n_listings", F.concat_ws(
        "\n", F.lit(LIST_TASK), F.concat(F.lit("CANDIDATE: "), F.col("query")),
        F.array_join(F.transform("lines", lambda e: e["line"]), "\n"), F.lit(LIST_ANSWER)).alias("request"))
