"""The registered queries: each operator over its whole table, with the digest
columns its contract names, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (chat, containment, filter_audit, licenses, line_dedup, minhash, packing, periodic, quality,
                          secrets, simhash, toxicity, vector_topk)
from rankloom.llm.common import Scratch, table


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("tox.score").alias("score"),
                        (F.col("tox.score") >= 0.7).cast("int").alias("predicted"), F.col("tox.spans").alias("spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edits(table(spark, sf_dir, "documents"), words=5)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=1024,
                          encode_special_tokens=False)
    return pieces.drop("ids")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the features of every whole text once: learning and scoring read them
    docs = Scratch(spark, "op6").save(
        quality.describe(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "features")
    held_out = _remainder(5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out), level=0.3)
    found = quality.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
                        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                 words=5, threshold=0.8)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.expand(turns.unionByName(extra)))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "extra"))
    return found.select("doc_id", *(secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
                        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(every).alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))
    return filter_audit.audit(masks, "ABCDE")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), min_length=24, min_periods=3, edit=periodic.planted)


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3_SQL = f"""
with line as (
  select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (select *, {_ASCII_LOWER.format(f"trim(line, {_SPACE})")} as key from line),
shared as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where s.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where s.key is null), '')) as kept_sha256
from keyed left join shared s using (key)
group by doc_id"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"

OP7_SQL = f"""
with item_words as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
item as (
  select distinct item_id, least(len(w), 5) as k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as s
  from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from item_words where len(w) > 0)),
sized as (select item_id, count(*) as n from item group by item_id),
doc_words as (select doc_id, {_WORDS} as w from documents where doc_id is not null),
doc as (
  select distinct doc_id, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select *, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) as i
        from doc_words, (select distinct k from item))),
pairs as (select doc_id, item_id, count(*) as n_shared from doc join item using (k, s) group by doc_id, item_id)
select doc_id, item_id, n as n_shingles, n_shared, n_shared / n as containment
from pairs join sized using (item_id) where n_shared / n >= 0.8 - 1e-9"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    c = f"translate(coalesce({text}, ''), {_sql_text(licenses.UPPER + licenses.QUOTES)}, " \
        f"{_sql_text(licenses.LOWER + licenses.PLAIN_QUOTES)})"
    for pattern, to in ((licenses.COPYRIGHT_LINE, ""), *licenses.SPELLINGS, (licenses.PUNCTUATION, " "),
                        (r"[\x20\x09\x0b-\x0d]+", " "), (r"\x20?\n\x20?", "\n")):
        to = to.replace("$", "\\")
        c = f"regexp_replace({c}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return f"trim({c}, ' ')"


OP8_SQL = f"""
with pairs(license_id, body) as (values {", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in licenses.KNOWN)}),
known as (
  select min(license_id) as license_id, sha256(trim(regexp_replace({_canonical_sql("body")}, '[\\x20\\n]+', ' ', 'g'), ' ')) as digest
  from pairs group by 2),
own as (select doc_id, {_canonical_sql("text")} as lines from documents),
line as (select distinct doc_id, unnest(string_split(lines, chr(10))) as line from own),
found as (
  select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices
  from line join known on sha256(line) = digest where line <> '' group by doc_id),
whole as (select doc_id, sha256(trim(regexp_replace(lines, '[\\x20\\n]+', ' ', 'g'), ' ')) as canonical_sha256 from own)
select w.doc_id, canonical_sha256, license_id, coalesce(notices, '') as notices
from whole w left join known on canonical_sha256 = digest left join found f on f.doc_id = w.doc_id"""

OP9_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(role) + 4 + length(text) + 5
            + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) as n,
         row_number() over (partition by conv_id order by turn, role, text) as pos
  from said),
placed as (
  select *, sum(n) over (partition by conv_id order by pos) as upto,
         row_number() over (partition by conv_id order by pos desc) as back
  from sized)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(coalesce(sum(upto) filter (where role = 'assistant' or back = 1), 0) as bigint) as formatted_chars
from placed group by conv_id"""

_WORD_LIST = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP11_SQL = f"""
with doc as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
first as (select text, min(doc_id) as first_id from doc group by text),
known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
judged as (
  select part, coalesce(good, 0) as good, coalesce(d.toxic, 0) as toxic,
         [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] as fails
  from (select *, {_WORD_LIST} as w from doc left join first using (text) left join known using (doc_id)) d),
summed as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 3, 4, 5]) as f),
perm as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.f, b.f, c.f, d.f, e.f] as fs
  from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
step as (select filter_order, fs, unnest([1, 2, 3, 4, 5]) as step from perm),
here as (
  select part, filter_order, step, fs[step] as f, n, good, toxic, fails[fs[step]] as failing,
         len(list_filter(fs[:step - 1], lambda x: fails[x])) = 0 as reached,
         len(list_filter(fails, lambda x: x)) = 1 as alone
  from summed, step),
counted as (
  select part, filter_order, step, f,
         cast(coalesce(sum(n) filter (where reached and not failing), 0) as bigint) as kept,
         cast(coalesce(sum(n) filter (where reached and failing), 0) as bigint) as removed,
         cast(coalesce(sum(n) filter (where not reached and failing), 0) as bigint) as redundant,
         cast(coalesce(sum(n) filter (where failing and alone), 0) as bigint) as unique_fails,
         cast(coalesce(sum(good) filter (where reached and failing), 0) as bigint) as good_lost,
         cast(coalesce(sum(toxic) filter (where reached and failing), 0) as bigint) as toxic_lost
  from here group by all)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from counted"""

OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 5"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_license_scans": op8_license_scans,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_secret_scans": op10_secret_scans,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_topk": op12_exact_topk,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_line_dedup": OP3_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_license_scans": OP8_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_exact_topk": OP12_SQL,
}
