"""Evaluation queries: score quality, rank position, pass rate, feedback effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import evals as EV
from rankloom.operators import feedback as FB
from rankloom.operators import proposals as P
from rankloom.operators import relevance as R
from rankloom.operators import scoring as S
from rankloom.plans import feedback as FBQ
from rankloom.plans import oracle_views as V
from rankloom.plans.registry import query
from rankloom.session import materialize
from rankloom.plans.scoring import _KD_SQL, _fleet_scored, relevance_ctes
from rankloom.sources import listings as L
from rankloom.sources.tables import read


def labelled(spark, sf_dir):
    """Four labelled listings per benchmark item, whatever a scorer thinks of
    them: its own text is strong, half of it with half of the next item's is
    mid, the item after that is weak, the one after extra weak."""
    it = read(spark, sf_dir, "benchmark").select("item_id", "text")
    n = it.select((F.max("item_id") + 1).alias("n")).scalar()

    def after(k, name):
        return it.select(F.pmod(F.col("item_id") - k, n).alias("item_id"), F.col("text").alias(name))

    x = it.join(after(1, "t1"), "item_id").join(after(2, "t2"), "item_id").join(after(3, "t3"), "item_id")
    cut = lambda c: F.floor(F.length(c) / 2).cast("int")
    mid = F.concat(F.substring("text", F.lit(1), cut("text")), F.lit(" "), F.substr("t1", cut("t1") + 1))
    texts = F.array(F.col("text"), mid, F.col("t2"), F.col("t3"))
    x = x.select("item_id", "text", F.posexplode(texts).alias("no", "listing"))
    role = F.element_at(F.array(*[F.lit(r) for r in EV.ROLES]), F.col("no") + 1)
    scored = R.pair_relevance(spark, x, ["item_id", "no"], "text", "listing", read(spark, sf_dir, "documents"), "doc_id", "text")
    return x.select("item_id", "no", role.alias("role")).join(scored, ["item_id", "no"])


_LABELLED_SQL = f"""
with n as (select max(item_id) + 1 as n from benchmark),
b as (select item_id, text from benchmark),
x as (
  select a.item_id, a.text, t1.text as t1, t2.text as t2, t3.text as t3
  from n, b a join b t1 on t1.item_id = (a.item_id + 1) % n.n join b t2 on t2.item_id = (a.item_id + 2) % n.n
  join b t3 on t3.item_id = (a.item_id + 3) % n.n),
four as (
  select item_id, text, 0 as no, 'strong' as role, text as listing from x
  union all select item_id, text, 1, 'mid', substr(text, 1, length(text) // 2) || ' ' || substr(t1, length(t1) // 2 + 1) from x
  union all select item_id, text, 2, 'weak', t2 from x union all select item_id, text, 3, 'extra_weak', t3 from x),
df as (select term, count(*) as df from (select distinct doc_id, unnest({V.tokens_sql('text')}) as term from documents) group by term),
w as (select term, cast(round(100 * ln((select count(*) from documents) / df)) as bigint) as weight from df),
hit as (select item_id, no, role, term, list_contains(d, term) as hit from (
          select item_id, no, role, {V.tokens_sql('listing')} as d, unnest(list_distinct({V.tokens_sql('text')})) as term from four)),
ev as (select item_id, no, role, cast(case when sum(weight) > 0 then floor(100 * sum(case when hit then weight else 0 end) / sum(weight))
                                       else 0 end as int) as score
       from hit join w using (term) group by item_id, no, role)"""


@query("eval_score_quality", "D12", _LABELLED_SQL + """,
g as (select item_id,
        max(score) filter (where role = 'strong') as strong, max(score) filter (where role = 'mid') as mid,
        max(score) filter (where role = 'weak') as weak, max(score) filter (where role = 'extra_weak') as extra_weak,
        max(score) filter (where no < 3) - min(score) filter (where no < 3) as span,
        round(avg(case when score % 5 <> 0 then 1.0 else 0.0 end), 4) as non_round_share
      from ev group by item_id)
select *, strong >= 60 as strong_ok, coalesce(weak <= 40, false) as weak_ok, coalesce(strong - weak >= 20, false) as gap_ok,
       coalesce(strong > mid, false) as order_ok, coalesce(span >= 30, false) as span_ok from g""")
def eval_score_quality(spark, sf_dir):
    return EV.score_quality(labelled(spark, sf_dir), "item_id")


@query("eval_rank_position", "E7", _LABELLED_SQL + """,
r as (select *, row_number() over (partition by item_id order by score desc, no) as rank from ev),
g as (select item_id, count(*) as n_candidates, max(rank) filter (where role = 'strong') as strong_rank,
             max(rank) filter (where role = 'weak') as weak_rank from r group by item_id)
select *, coalesce(strong_rank <= 2, false) as strong_in_top2,
       coalesce(weak_rank > n_candidates - 2, false) as weak_in_bottom2 from g""")
def eval_rank_position(spark, sf_dir):
    return EV.labelled_ranks(labelled(spark, sf_dir), "item_id", "no")


_PASS_SQL = "with " + relevance_ctes(False, "a_", "true").strip() + ",\n" + relevance_ctes(True, "b_", "true").strip() + f""",
found as (select item_id, doc_id from a_rel where score >= {R.MIN_SCORE}
          union select item_id, doc_id from b_rel where score >= {R.MIN_SCORE}),
runs as (select 'plain' as trial, * from a_rel semi join found using (item_id, doc_id)
         union all select 'evidence', * from b_rel semi join found using (item_id, doc_id)),
r as (select *, row_number() over (partition by trial, item_id order by score desc, doc_id) as rank from runs),
t as (select item_id, trial, max(case when rank = 1 then score end) >= 60 as strong_ok,
             coalesce(min(case when score = 100 then rank end) <= 2, false) as gold_ok
      from r group by item_id, trial),
checks as (select item_id, 'strong_ge_60' as "check", trial, strong_ok as passed from t
           union all select item_id, 'gold_top2', trial, gold_ok from t)
select item_id, "check", count(*) as n_trials, cast(count_if(passed) as bigint) as passes,
       round(count_if(passed) / count(*), 4) as rate, count_if(passed) >= ceil(count(*) * 0.8) as passed,
       count_if(passed) >= ceil(count(*) * 0.5) as passed_half
from checks group by item_id, "check\""""


@query("eval_pass_rate", "D11", _PASS_SQL)
def eval_pass_rate(spark, sf_dir):
    # both trials (plain, evidence weighting) from one relevance pass, in long form
    both = R.relevance_variants(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                                read(spark, sf_dir, "documents"), "doc_id", "text")
    r = materialize(both.select("item_id", "doc_id", F.expr(
        "stack(2, 'plain', score_plain, 'evidence', score_evidence) as (trial, score)")), "relevance-trials")
    keys = ["item_id", "trial"]
    strong = r.groupBy(*keys).agg((F.max("score") >= EV.STRONG_MIN).alias("strong_ok"))
    gold = EV.rank_position(r, keys, "doc_id", F.col("score") == 100).select(*keys, F.col("gold_in_top2").alias("gold_ok"))
    t = strong.join(gold, keys)
    trials = (t.select("item_id", F.lit("strong_ge_60").alias("check"), "trial", F.col("strong_ok").alias("passed"))
              .unionByName(t.select("item_id", F.lit("gold_top2").alias("check"), "trial", F.col("gold_ok").alias("passed"))))
    half = EV.pass_rate(trials, ["item_id", "check"], 0.5).select("item_id", "check", F.col("passed").alias("passed_half"))
    return EV.pass_rate(trials, ["item_id", "check"]).join(half, ["item_id", "check"])


@query("eval_feedback_effect", "D14", _KD_SQL + """
select profile_id, count(*) as n, round(avg(adjusted - raw_score), 4) as mean_change,
       cast(count_if(adjusted - raw_score <> 0) as bigint) as n_changed,
       round(avg(case when adjusted - raw_score between -5 and 3 then 1.0 else 0.0 end), 4) as in_band_share
from kd group by profile_id""")
def eval_feedback_effect(spark, sf_dir):
    x = _fleet_scored(spark, sf_dir).select("profile_id", F.col("adjusted").alias("with_feedback"),
                                            F.col("score").cast("double").alias("without_feedback"))
    return EV.feedback_effect(x, "profile_id")


_FEEDBACK_GAP_SQL = FBQ.KEYWORD_SUGGEST_SQL.replace("user_rating in (1, -1)),\nlt", "user_rating in (1, -1) and age % 2 = 1),\nlt").replace(
    "\nselect * from b where rank <= 5", ",\nsugg as (select * from b where rank <= 5") + f"""),
held as (select * from newest where age <= {FB.FEEDBACK_WINDOW} and user_rating in (1, -1) and age % 2 = 0),
moved as (
  select h.profile_id, h.job_url, h.user_rating, cast(h.score as double) as without_feedback,
         greatest(0.0, least(100.0, h.score + greatest(-20.0, least(20.0, coalesce(sum(s.weight), 0)))))::double as with_feedback
  from held h left join sugg s on s.profile_id = h.profile_id and contains(lower(h.title), lower(s.keyword))
  group by h.profile_id, h.job_url, h.user_rating, h.score),
g as (
  select profile_id, cast(count_if(user_rating = 1) as bigint) as n_liked, cast(count_if(user_rating = -1) as bigint) as n_disliked,
         avg(with_feedback) filter (where user_rating = 1) as l_w, avg(without_feedback) filter (where user_rating = 1) as l_o,
         avg(with_feedback) filter (where user_rating = -1) as d_w, avg(without_feedback) filter (where user_rating = -1) as d_o
  from moved group by profile_id)
select profile_id, n_liked, n_disliked, round(l_w - l_o, 4) as liked_change, round(d_w - d_o, 4) as disliked_change,
       round(l_o - d_o, 4) as gap_without, round(l_w - d_w, 4) as gap_with, round((l_w - d_w) - (l_o - d_o), 4) as gap_change,
       coalesce(l_w - l_o >= -5, true) as liked_ok, coalesce(d_w - d_o <= 3, true) as disliked_ok,
       coalesce((l_w - d_w) - (l_o - d_o) >= -5, true) as gap_ok
from g"""


@query("eval_feedback_gap", "D14 J8 D8", _FEEDBACK_GAP_SQL)
def eval_feedback_gap(spark, sf_dir):
    """Keywords learnt from every second rated listing of a profile (by age), and
    what they do to the scores of the others."""
    rated = materialize(FB.newest_feedback(FBQ.state_rows(spark, sf_dir)).where(F.col("user_rating").isin(1, -1)), "rated")
    sugg = P.suggest_keywords(rated.where("_age % 2 = 1"), L.profiles(spark, sf_dir).select("profile_id", "scoring"))
    lists = sugg.groupBy("profile_id").agg(F.collect_list(F.struct("keyword", F.col("weight").cast("double").alias("weight"))).alias("learnt"))
    none = F.array().cast("array<struct<keyword:string,weight:double>>")
    x = rated.where("_age % 2 = 0").join(lists, "profile_id", "left").withColumn("raw", F.col("score").cast("double"))
    x = x.select("profile_id", "user_rating", F.col("raw").alias("without_feedback"),
                 S.adjust("raw", S.keyword_delta("title", F.coalesce("learnt", none), none)).alias("with_feedback"))
    return EV.feedback_gap(x, "profile_id")
