"""Ingest chain: landed fetch rows -> normalised, de-duplicated, pre-filtered listings.

``raw -> normalize (A3) -> first arrival (E1) -> known-URL anti join (C1)
-> region (B1) / language (B2, J9) -> decision counters (D5)``

E1 and C1 both key on ``job_url``; the first-arrival window and the anti join
share that hash partitioning, so one exchange of the batch serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import filters as B
from rankloom.operators.language import LanguageModel, detect
from rankloom.operators.ranking import first_per_key, top_n_per_group

DEFAULT_LOCATIONS = ["Toronto, ON"]
DEFAULT_RESULTS_PER_SITE = 25
DEEP_RESULTS_PER_SITE = 50
DEFAULT_HOURS_OLD = 24

RAW_TEXT_FIELDS = ("title", "company", "location", "job_url", "date_posted", "job_type", "description")


def search_tasks(profiles: DataFrame, deep: bool = False) -> DataFrame:
    """A1: every term x every location of each profile (explode inside the row,
    no cross join between tables). Deep mode: 50 results and no time bound."""
    locs = F.coalesce(F.col("search.locations"), F.array(*[F.lit(x) for x in DEFAULT_LOCATIONS]))
    per_site = F.lit(DEEP_RESULTS_PER_SITE) if deep else \
        F.coalesce(F.col("search.results_per_site"), F.lit(DEFAULT_RESULTS_PER_SITE))
    hours = F.lit(None).cast("int") if deep else F.coalesce(F.col("search.hours_old"), F.lit(DEFAULT_HOURS_OLD))
    return (profiles
            .select("profile_id", F.posexplode(F.coalesce(F.col("search.terms"), F.array())).alias("term_pos", "term"),
                    locs.alias("_locs"), per_site.alias("results_wanted"), hours.alias("hours_old"))
            .select("profile_id", "term_pos", "term", F.posexplode("_locs").alias("location_pos", "location"),
                    "results_wanted", "hours_old"))


def scan_cap(raw: DataFrame, task_keys, results_wanted: int, as_of: str | None, hours_old: int | None) -> DataFrame:
    """A2: at most ``results_wanted`` rows per (site, task), in arrival order, and
    only rows no older than ``hours_old`` before ``as_of`` (None = deep mode)."""
    x = raw
    if hours_old is not None and as_of is not None:
        x = x.filter(F.col("discovered_at") >= F.timestamp_add("HOUR", F.lit(-hours_old), F.lit(as_of).cast("timestamp")))
    return top_n_per_group(x, list(task_keys), [F.col("arrival")], results_wanted, rank_col="fetch_rank")


def normalize(raw: DataFrame, parity: bool = False) -> DataFrame:
    """A3: text fields as ``str(x or "")``, ``company`` -> ``employer``, flags to boolean.

    With ``parity`` a missing value behaves like the reference's pandas NaN:
    text becomes ``'nan'`` and a missing remote flag counts as remote.
    """
    missing_text = F.lit("nan") if parity else F.lit("")
    cols = {f: F.coalesce(F.col(f), missing_text) for f in RAW_TEXT_FIELDS}
    remote = F.coalesce(F.col("is_remote"), F.lit(parity))
    out = [c for c in raw.columns if c not in RAW_TEXT_FIELDS + ("is_remote",)]
    return raw.select(*out, *[cols[f].alias("employer" if f == "company" else f) for f in RAW_TEXT_FIELDS],
                      remote.alias("is_remote"))


def first_arrival(batch: DataFrame) -> DataFrame:
    """B3 + E1: drop rows without URL, then keep the first arrival per URL."""
    return first_per_key(batch.filter(B.has_url("job_url")), ["job_url"], [F.col("arrival")])


def new_only(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Drop URLs already stored. De-duplicate first (the first occurrence
    decides even if it is filtered later), then anti join, then filter."""
    return first_arrival(batch).join(known.select("job_url").distinct(), "job_url", "left_anti")


def quality_rules(text) -> list[Column]:
    """B17 rule columns over the whole text: words, lines, repeated-line share, letter share."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.split(t, "\n")
    n_lines = F.size(lines).cast("bigint")
    dup_share = F.lit(1.0) - F.size(F.array_distinct(lines)) / n_lines
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    letter_share = F.when(F.length(t) > 0, letters / F.length(t)).otherwise(F.lit(0.0))
    n_words = F.size(tokens(t)).cast("bigint")
    return [n_words.alias("n_words"), n_lines.alias("n_lines"),
            F.round(dup_share, 4).alias("dup_line_share"), F.round(letter_share, 4).alias("letter_share")]


QUALITY_MIN_WORDS = 50
QUALITY_MAX_DUP_SHARE = 0.3
QUALITY_MIN_LETTER_SHARE = 0.6


def quality_pass() -> Column:
    return ((F.col("n_words") >= QUALITY_MIN_WORDS) & (F.col("dup_line_share") <= QUALITY_MAX_DUP_SHARE)
            & (F.col("letter_share") >= QUALITY_MIN_LETTER_SHARE))


def decide(batch: DataFrame, known: DataFrame, allowed_regions: list[str] | None,
           require_language: str | None, model: LanguageModel, id_col: str = "id",
           detect_all: bool = False) -> DataFrame:
    """Tag every landed row with its ingest decision (D5 input):
    ``no_url``, ``duplicate`` (later arrival in batch), ``known``, ``skipped_region``,
    ``skipped_language`` or ``new``. The language is detected (by ``model``) only for
    rows that the cheaper rules keep, unless ``detect_all`` asks for it on every row.

    The first arrival per URL comes from a grouped ``min`` (partial aggregation
    before the shuffle), not a window, so a URL that lands millions of times
    never sorts in one task; the join back is an equi join AQE can split.
    """
    firsts = (batch.filter(B.has_url("job_url")).groupBy("job_url").agg(F.min("arrival").alias("_first"))
              .join(known.select("job_url").distinct().withColumn("_known", F.lit(True)), "job_url", "left"))
    regions = F.array(*[F.lit(r) for r in allowed_regions]) if allowed_regions else \
        F.lit(None).cast("array<string>")
    cheap = (F.when(~B.has_url("job_url"), "no_url")
             .when(F.col("arrival") > F.col("_first"), "duplicate")
             .when(F.coalesce(F.col("_known"), F.lit(False)), "known")
             .when(~B.region_ok("location", "is_remote", regions), "skipped_region"))
    # rows without a URL find no first arrival; left out, they are no hot key of the join
    urls = batch.filter(B.has_url("job_url")).join(firsts, "job_url", "left")
    bare = batch.filter(~B.has_url("job_url")).withColumn("_first", F.lit(None)).withColumn("_known", F.lit(None))
    x = urls.unionByName(bare).withColumn("_cheap", cheap)
    det = detect(x if detect_all else x.filter(F.col("_cheap").isNull()), id_col,
                 F.concat_ws(" ", "title", "description"), model)
    x = x.join(det, id_col, "left")
    decision = (F.when(F.col("_cheap").isNotNull(), F.col("_cheap"))
                .when(~B.language_ok("detected_language", F.lit(require_language)), "skipped_language")
                .otherwise("new"))
    return x.withColumn("decision", decision).drop("_first", "_known", "_cheap")


def counters(decided: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One conditional aggregate over the decision column (map-side partial)."""
    aggs = [F.count_if(F.col("decision") == d).alias(f"n_{d}")
            for d in ("new", "skipped_region", "skipped_language", "known", "duplicate", "no_url")]
    g = decided.groupBy(*keys) if keys else decided.groupBy()
    return g.agg(F.count("*").alias("n_rows"), *aggs)
