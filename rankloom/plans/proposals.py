"""Proposal and reply queries: apply, revert, texts, revision, transcript, reply matching and intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.text import bound, first_word, strip_quoted
from rankloom.operators import feedback as FB
from rankloom.operators import proposals as P
from rankloom.operators import replies as RP
from rankloom.operators import resume as RS
from rankloom.plans import oracle_views as V
from rankloom.plans.scoring import relevance_ctes
from rankloom.plans.feedback import state_rows
from rankloom.plans.registry import query
from rankloom.session import materialize
from rankloom.plans import feedback as FBQ
from rankloom.sources import listings as L
from rankloom.sources.inbox import proposals_from, replies_from
from rankloom.sources.tables import read

_LONG_WORDS = f"list_filter({V.tokens_sql('text')}, lambda w: length(w) >= {RS.MIN_LETTERS})"
_PHRASES = """select {0}, a || ' ' || b as phrase from (
  select {0}, unnest(t) as a, unnest(list_append(t[2:], null)) as b from ({1})) where length(a) >= 3 and length(b) >= 3"""

RESUME_SUGGEST_SQL = "with " + relevance_ctes(False, bar="matched > 0").strip() + f""",
best as (select item_id, doc_id from rel qualify row_number() over (partition by item_id order by matched desc, doc_id) <= {RS.BEST_LISTINGS}),
dw as (select distinct doc_id, word from (select doc_id, unnest({_LONG_WORDS}) as word from documents)),
n_docs as (select count(*) as docs from documents),
dfs as (select word, count(*) as df from dw group by word),
own as (select item_id, word, count(*) as tf from (select item_id, unnest({_LONG_WORDS}) as word from benchmark) group by all),
bs as (select item_id, word, tf * cast(round(1000 * ln((docs + 1) / (coalesce(df, 0) + 1))) as bigint) as s
       from n_docs, own left join dfs using (word)),
boosts as (select item_id, 'boost' as kind, row_number() over (partition by item_id order by s desc, word) as rank, word as keyword from bs),
said as (select item_id, phrase, count(*) as tf from ({_PHRASES.format("item_id", f"select item_id, {V.tokens_sql('text')} as t from benchmark")}) group by all),
held as (select phrase, count(*) as n_both from (
  select distinct * from ({_PHRASES.format("doc_id", f"select doc_id, {V.tokens_sql('text')} as t from documents")})) group by phrase),
ps as (select item_id, phrase, tf, cast(round(1000 * ln((coalesce(n_both, 0) + 1) * cast(docs as double) /
              ((coalesce(x.df, 0) + 1) * (coalesce(y.df, 0) + 1)))) as bigint) as s
       from n_docs, said left join held using (phrase) left join dfs x on x.word = split_part(phrase, ' ', 1)
       left join dfs y on y.word = split_part(phrase, ' ', 2)),
titles as (select item_id, 'title' as kind, row_number() over (partition by item_id order by s desc, tf desc, phrase) as rank,
                  replace(upper(phrase[1]), 'ẞ', 'Ss') || split_part(phrase, ' ', 1)[2:] || ' ' || replace(upper(split_part(phrase, ' ', 2)[1]), 'ẞ', 'Ss') || split_part(phrase, ' ', 2)[2:] as keyword from ps),
spared as (select item_id, word from own union select item_id, word from best join dw using (doc_id)),
free as (select i.item_id, d.word, d.df from (select distinct item_id from benchmark) i cross join
              (select * from dfs order by df desc, word limit (select max(n) + {RS.PENALTIES} from (select count(*) as n from spared group by item_id))) d
         where not exists (select 1 from spared s where s.item_id = i.item_id and s.word = d.word)),
penalties as (select item_id, 'penalize' as kind, row_number() over (partition by item_id order by df desc, word) as rank, word as keyword from free)
select item_id, kind, rank, keyword, cast({RS.BOOSTS + 1} - rank as int) as weight from boosts where rank <= {RS.BOOSTS}
union all select item_id, kind, rank, keyword, 0 from titles where rank <= {RS.TITLES}
union all select item_id, kind, rank, keyword, cast(-54 + 4 * rank as int) from penalties where rank <= {RS.PENALTIES}"""


@query("resume_suggest", "J8", RESUME_SUGGEST_SQL)
def resume_suggest(spark, sf_dir):
    """First set-up of every benchmark text as a resume."""
    return RS.suggest_from_resumes(spark, read(spark, sf_dir, "benchmark"), "item_id", "text",
                                   read(spark, sf_dir, "documents"), "doc_id", "text")


REVERTED_SEGMENT = "MACHINERY"
ACTED_SEGMENT = "BUILDING"


def suggestions(spark, sf_dir):
    rated = FB.newest_feedback(state_rows(spark, sf_dir)).filter(F.col("user_rating").isin(1, -1))
    # read three times below (boosts, penalties, profile ids): materialize once
    return materialize(P.suggest_keywords(rated, L.profiles(spark, sf_dir).select("profile_id", "scoring")))


def proposals(spark, sf_dir):
    """One pending proposal per profile with suggestions: suggested boosts and
    penalties, boosts as new search terms, plus one item the profile already
    has in another case (which apply must skip)."""
    s = suggestions(spark, sf_dir)

    def items(kind):
        g = s.filter(F.col("kind") == kind).groupBy("profile_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "keyword", "weight"))).alias("_s"))
        return g.select("profile_id", F.transform("_s", lambda e: F.struct(
            e["keyword"].alias("keyword"), e["weight"].cast("double").alias("weight"))).alias(f"{kind}_sugg"))

    ids = s.select("profile_id").distinct()
    prof = L.profiles(spark, sf_dir).select("profile_id", "segment", "scoring")
    # BUILDING profiles already decided on theirs: stored, but not active
    status = F.when(F.col("segment") == ACTED_SEGMENT, "approved").otherwise("pending")
    x = ids.join(prof, "profile_id").join(items("boost"), "profile_id", "left").join(items("penalize"), "profile_id", "left")
    clash = F.struct(F.upper(F.array_min(F.transform("scoring.boost", lambda k: k["keyword"]))).alias("keyword"),
                     F.lit(5.0).alias("weight"))
    empty = F.array().cast("array<struct<keyword:string,weight:double>>")
    return x.select(
        "profile_id", "segment",
        F.concat(F.coalesce("boost_sugg", empty), F.array(clash)).alias("boost_add"),
        F.coalesce("penalize_sugg", empty).alias("penalize_add"),
        F.concat(F.transform(F.coalesce("boost_sugg", empty), lambda e: e["keyword"]),
                 F.array(F.upper("segment"))).alias("terms_add"),
        F.concat(F.lit("Proposal for profile "), F.col("profile_id").cast("string")).alias("summary"),
        status.alias("status"))


def active(proposals_df):
    """Only a ``pending`` proposal is active; anything else counts as none."""
    return proposals_df.filter(F.col("status") == "pending")


def applied(spark, sf_dir):
    return P.apply(L.profiles(spark, sf_dir).drop("segment"), active(proposals(spark, sf_dir)))


def _names(c):
    return F.array_join(F.transform(c, lambda k: k["keyword"]), ", ")


_SUGG = FBQ.KEYWORD_SUGGEST_SQL.replace("\nselect * from b where rank <= 5 union all select * from p where rank <= 5",
                                        """,
sugg as (select * from b where rank <= 5 union all select * from p where rank <= 5)""")

PROPOSAL_SQL = _SUGG + """,
ids as (select distinct s.profile_id from sugg s join profiles_flat p on p.profile_id = s.profile_id
        where p.segment <> 'BUILDING'),
pb as (select profile_id, rank as ord, keyword, cast(weight as double) as weight from sugg where kind = 'boost'
       union all
       select i.profile_id, 1000, upper(min(k.keyword)), 5.0 from ids i join profiles_flat p on p.profile_id = i.profile_id
       join segment_keywords k on k.segment = p.segment and k.kind = 'boost' group by i.profile_id),
pp as (select profile_id, rank as ord, keyword, cast(weight as double) as weight from sugg where kind = 'penalize'),
pt as (select profile_id, rank as ord, keyword as term from sugg where kind = 'boost'
       union all select i.profile_id, 1000, upper(p.segment) from ids i join profiles_flat p on p.profile_id = i.profile_id),
ex_b as (select i.profile_id, k.ord, k.keyword from ids i join profiles_flat p on p.profile_id = i.profile_id
         join segment_keywords k on k.segment = p.segment and k.kind = 'boost'),
ex_p as (select i.profile_id, k.ord, k.keyword from ids i join profiles_flat p on p.profile_id = i.profile_id
         join segment_keywords k on k.segment = p.segment and k.kind = 'penalize'),
ex_t as (select i.profile_id, 0 as ord, lower(p.segment) as term from ids i join profiles_flat p on p.profile_id = i.profile_id),
add_b as (select * from pb where not exists (select 1 from ex_b e where e.profile_id = pb.profile_id and lower(e.keyword) = lower(pb.keyword))),
add_p as (select * from pp where not exists (select 1 from ex_p e where e.profile_id = pp.profile_id and lower(e.keyword) = lower(pp.keyword))),
add_t as (select * from pt where not exists (select 1 from ex_t e where e.profile_id = pt.profile_id and lower(e.term) = lower(pt.term))),
nb as (select i.profile_id, count(a.keyword) as n from ids i left join add_b a on a.profile_id = i.profile_id group by i.profile_id),
np as (select i.profile_id, count(a.keyword) as n from ids i left join add_p a on a.profile_id = i.profile_id group by i.profile_id),
nt as (select i.profile_id, count(a.term) as n from ids i left join add_t a on a.profile_id = i.profile_id group by i.profile_id),
after_b as (select profile_id, string_agg(keyword, ', ' order by src, ord) as s from
            (select profile_id, 0 as src, ord, keyword from ex_b union all select profile_id, 1, ord, keyword from add_b) group by profile_id),
after_p as (select i.profile_id, coalesce(string_agg(x.keyword, ', ' order by x.src, x.ord), '') as s from ids i left join
            (select profile_id, 0 as src, ord, keyword from ex_p union all select profile_id, 1, ord, keyword from add_p) x
            on x.profile_id = i.profile_id group by i.profile_id),
after_t as (select profile_id, string_agg(term, ', ' order by src, ord) as s from
            (select profile_id, 0 as src, ord, term from ex_t union all select profile_id, 1, ord, term from add_t) group by profile_id),
seg as (select i.profile_id, p.segment from ids i join profiles_flat p on p.profile_id = i.profile_id)"""


@query("proposal_apply", "C9 G2 D6 A9", PROPOSAL_SQL + """
select i.profile_id, nb.n as n_boost_added, np.n as n_penalize_added, nt.n as n_terms_added,
       ab.s as boost_after, ap.s as penalize_after, att.s as terms_after,
       coalesce(nullif(concat_ws(', ',
         case when nb.n > 0 then cast(nb.n as varchar) || ' boost keyword(s)' end,
         case when np.n > 0 then cast(np.n as varchar) || ' penalize keyword(s)' end,
         case when nt.n > 0 then cast(nt.n as varchar) || ' search term(s)' end), ''), 'no new items') as change_text
from ids i join nb on nb.profile_id = i.profile_id join np on np.profile_id = i.profile_id
join nt on nt.profile_id = i.profile_id join after_b ab on ab.profile_id = i.profile_id
join after_p ap on ap.profile_id = i.profile_id join after_t att on att.profile_id = i.profile_id""")
def proposal_apply(spark, sf_dir):
    x = applied(spark, sf_dir)
    return x.select(
        "profile_id",
        F.size("boost_added").cast("bigint").alias("n_boost_added"),
        F.size("penalize_added").cast("bigint").alias("n_penalize_added"),
        F.size("terms_added").cast("bigint").alias("n_terms_added"),
        _names("scoring.boost").alias("boost_after"), _names("scoring.penalize").alias("penalize_after"),
        F.array_join("search.terms", ", ").alias("terms_after"), "change_text")


@query("proposal_revert", "C10 G6 B16 F5 A9", PROPOSAL_SQL + f"""
select i.profile_id,
  case when s.segment = '{REVERTED_SEGMENT}' then 0 else nb.n + np.n + nt.n end as removed,
  case when s.segment = '{REVERTED_SEGMENT}' then 'already reverted' end as refused, true as reverted,
  case when s.segment = '{REVERTED_SEGMENT}' then ab.s
       else (select string_agg(keyword, ', ' order by ord) from ex_b e where e.profile_id = i.profile_id) end as boost_after,
  case when s.segment = '{REVERTED_SEGMENT}' then att.s else s2.t end as terms_after
from ids i join seg s on s.profile_id = i.profile_id
join nb on nb.profile_id = i.profile_id join np on np.profile_id = i.profile_id join nt on nt.profile_id = i.profile_id
join after_b ab on ab.profile_id = i.profile_id join after_t att on att.profile_id = i.profile_id
join (select profile_id, string_agg(term, ', ' order by ord) as t from ex_t group by profile_id) s2 on s2.profile_id = i.profile_id""")
def proposal_revert(spark, sf_dir):
    x = applied(spark, sf_dir)
    # history entry 1 of each profile; the MACHINERY ones were reverted before
    entries = x.select("profile_id", F.lit(1).alias("entry_id"), "boost_added", "penalize_added", "terms_added",
                       (F.col("segment") == REVERTED_SEGMENT).alias("reverted"))
    r = P.revert(x.select("profile_id", "scoring", "search"), entries)
    return r.select("profile_id", F.col("removed").cast("bigint").alias("removed"), "refused", "reverted",
                    _names("boost").alias("boost_after"), F.array_join("terms", ", ").alias("terms_after"))


def insight_history(spark, sf_dir):
    """Applied insights as landed, and the requests to take some back."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    entries = e.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("profile_id"), F.col("event_id").alias("entry_id"),
        F.col("ts").cast("timestamp").alias("applied_at"), (F.col("value") >= 30).alias("reverted"))
    requests = e.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("profile_id"),
        (F.floor("value") - 1).cast("bigint").alias("position"))
    return entries, requests


@query("history_revert", "F5 B16 G6", """
with h as (select user_id as profile_id, event_id as entry_id, value >= 30 as reverted,
                  row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as position
           from events where event_type = 'signup'),
r as (select event_id as request_id, user_id as profile_id, cast(floor(value) as bigint) - 1 as position
      from events where event_type = 'error'),
f as (select profile_id, position, min(request_id) as first_request from r group by all)
select request_id, r.profile_id, r.position, cast(entry_id as double) as entry_id,
       case when entry_id is null then 'not found' when reverted or request_id > first_request then 'already reverted'
            else 'reverted' end as outcome
from r join f on f.profile_id = r.profile_id and f.position = r.position
left join h on h.profile_id = r.profile_id and h.position = r.position""")
def history_revert(spark, sf_dir):
    x = P.revert_requests(*insight_history(spark, sf_dir))
    return x.withColumn("entry_id", F.col("entry_id").cast("double"))  # may be missing


@query("proposal_text", "H24 H27 A9", PROPOSAL_SQL + """
select i.profile_id, concat_ws(chr(10),
  'Proposal for profile ' || cast(i.profile_id as varchar), '',
  'Boost: ' || coalesce(nullif((select string_agg(keyword, ', ' order by ord) from pb where pb.profile_id = i.profile_id), ''), 'none'),
  'Penalize: ' || nullif((select string_agg(keyword, ', ' order by ord) from pp where pp.profile_id = i.profile_id), ''),
  'New search terms: ' || coalesce(nullif((select string_agg(term, ', ' order by ord) from pt where pt.profile_id = i.profile_id), ''), 'none'),
  '', 'Reply yes to apply, no to discard, or tell me what to change.') as body
from ids i""")
def proposal_text(spark, sf_dir):
    x = active(proposals(spark, sf_dir))
    return x.select("profile_id", P.proposal_text("summary", "boost_add", "penalize_add", "terms_add").alias("body"))


# --------------------------------------------------------------------------- conversations and replies

def _conv(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query("transcript", "H25", """
select conv_id, count(*) as n_turns,
       string_agg(case when role = 'assistant' then 'AI' else 'User' end || ': ' || text, chr(10) order by turn) as transcript
from conversations group by conv_id""")
def transcript(spark, sf_dir):
    c = _conv(spark, sf_dir)
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"),
                                 F.count("*").alias("n_turns"))
    conv = F.transform("_t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return g.select("conv_id", "n_turns", P.transcript(conv).alias("transcript"))


@query("proposal_revise", "J12 H25", """
with last_user as (select conv_id, max(turn) as last_turn from conversations where role = 'user' group by conv_id)
select c.conv_id, count(*) as n_turns,
       string_agg(case when role = 'assistant' then 'AI' else 'User' end || ': ' || text, chr(10) order by turn) as transcript
from conversations c join last_user l on l.conv_id = c.conv_id and c.turn <= l.last_turn
group by c.conv_id""")
def proposal_revise(spark, sf_dir):
    c = _conv(spark, sf_dir)
    last = c.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    x = c.join(last, "conv_id")
    prior = (x.filter(F.col("turn") < F.col("last_turn")).groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t")))
    reply = x.filter(F.col("turn") == F.col("last_turn")).select("conv_id", F.col("text").alias("reply"))
    props = (reply.select("conv_id").join(prior, "conv_id", "left")
             .select("conv_id", F.transform(F.coalesce("_t", F.array()), lambda m: F.struct(
                 m["role"].alias("role"), m["text"].alias("content"))).alias("conversation"),
                     F.array().cast("array<string>").alias("terms_add")))
    rev = P.revise(props, reply, key="conv_id")
    return rev.select("conv_id", F.size("conversation").cast("bigint").alias("n_turns"),
                      P.transcript("conversation").alias("transcript"))


def landed_replies(spark, sf_dir):
    """Inbox as landed (see ``sources.inbox``)."""
    return replies_from(_conv(spark, sf_dir))


_MID = "'<proposal-' || cast({x} as varchar) || '@rankloom.local>'"


REPLY_MATCH_CTES = f"""
r as (
  select conv_id * 1000 + turn as uid,
         case when turn % 4 = 1 then {_MID.format(x='conv_id')} end as in_reply_to,
         case when turn % 4 = 3 then [{_MID.format(x='conv_id - 1')}, {_MID.format(x='conv_id')}]
              else [{_MID.format(x='conv_id + 1')}] end as refs,
         turn % 5 = 4 as seen
  from conversations where role = 'user' and turn > 0),
p as (select distinct conv_id as proposal_id, {_MID.format(x='conv_id')} as message_id from conversations),
u as (select * from r where not seen),
c as (select p.proposal_id, u.uid, 1 as prio from u join p on u.in_reply_to = p.message_id
      union all
      select p.proposal_id, u.uid, 2 from (select distinct uid, unnest(refs) as ref from u) u join p on u.ref = p.message_id),
b as (select proposal_id, uid, prio, row_number() over (partition by proposal_id order by prio, uid desc) as rn from c),
m as (select proposal_id, uid, case when prio = 1 then 'in_reply_to' else 'references' end as matched_by
      from b where rn = 1)"""


@query("header_decode", "H26", """
select conv_id, turn, concat('Re: ', text, case when turn % 3 = 2 then text else '' end, ' [', role, ']') as subject from conversations""")
def header_decode(spark, sf_dir):
    """Subjects as mail clients encode them, one to two words in base64 or quoted form, read back."""
    x = _conv(spark, sf_dir)
    data = F.encode("text", "UTF-8")
    b = F.concat(F.lit("=?UTF-8?B?"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")), F.lit("?="))
    q = F.concat(F.lit("=?utf-8?q?"), F.regexp_replace(F.hex(data), "(..)", "=$1"), F.lit("?="))
    word = F.when(F.col("turn") % 3 == 0, b).when(F.col("turn") % 3 == 1, q).otherwise(F.concat(b, F.lit("\r\n "), q))
    raw = F.concat(F.lit("Re: "), word, F.lit(" ["), F.col("role"), F.lit("]"))
    return x.select("conv_id", "turn", RP.decode_header(raw).alias("subject"))


@query("reply_match", "C8 E8", "with " + REPLY_MATCH_CTES + """
select proposal_id, uid, matched_by from m""")
def reply_match(spark, sf_dir):
    return RP.match(landed_replies(spark, sf_dir), proposals_from(_conv(spark, sf_dir)))


@query("reply_strip", "H12", """
with q as (
  select c.conv_id, c.turn, c.text ||
         case when p.text is not null then chr(10) || chr(10) || '> ' || replace(p.text, chr(10), chr(10) || '> ') else '' end as body
  from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1
  where c.role = 'user')
select conv_id, turn, regexp_replace(array_to_string(list_filter(string_split_regex(body, '\\r\\n|\\r|\\n'),
                                                                 lambda l: not starts_with(l, '>')), chr(10)),
                                     '^\\s+|\\s+$', '', 'g') as stripped
from q""")
def reply_strip(spark, sf_dir):
    c = _conv(spark, sf_dir)
    user = c.filter(F.col("role") == "user")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    quoted = F.concat(F.lit("\n\n> "), F.replace(F.col("prev"), F.lit("\n"), F.lit("\n> ")))
    body = F.concat(F.col("text"), F.coalesce(quoted, F.lit("")))
    x = user.join(prev, ["conv_id", "turn"], "left")
    return x.select("conv_id", "turn", strip_quoted(body).alias("stripped"))


def _sql_words(ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_FW = """
with t0 as (select conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from conversations where role = 'user'),
w0 as (select conv_id, turn, case when t = '' then '' else
         coalesce(regexp_replace(lower((string_split_regex(t, '\\s+'))[1]), '^[.,!?;:''"]+|[.,!?;:''"]+$', '', 'g'), '') end as w
       from t0),
w1 as (select *, regexp_replace(w, '[^\\x00-\\x7F]', '#', 'g') as wa from w0)"""


def _fuzzy_sql(ws):
    return (f"len(list_filter({_sql_words(ws)}, lambda v: levenshtein(wa, v) <= "
            f"case when length(v) <= 5 then 2 else 3 end)) > 0")


@query("reply_intent", "H9 H10 H11 C11", _FW + f"""
select conv_id, turn, w as first_word,
  case when w in ({', '.join(repr(x) for x in RP.APPROVE_WORDS)}) then 'approve'
       when w in ({', '.join(repr(x) for x in RP.REJECT_WORDS)}) then 'reject'
       when {_fuzzy_sql(RP.APPROVE_WORDS)} then 'approve'
       when {_fuzzy_sql(RP.REJECT_WORDS)} then 'reject'
       else 'freeform' end as intent
from w1""")
def reply_intent(spark, sf_dir):
    c = _conv(spark, sf_dir).filter(F.col("role") == "user")
    both = bound(first_word("text"), lambda w: F.struct(w.alias("first_word"), RP.word_intent(w).alias("intent")))
    return c.select("conv_id", "turn", F.explode(F.array(both)).alias("r")).select("conv_id", "turn", "r.*")
