"""Derived input tables built from the landed test tables.

Two worlds, both read straight from the landed tables so their size grows
with the data:

* the *board* (one profile, as in a single-user install): listings come from
  ``documents`` (+ ``labels`` for ratings, ``nation`` for locations), the
  user's feedback log from ``events``;
* the *fleet* (many profiles): profiles are ``customer`` rows, each profile's
  fetched listings are the ``lineitem`` rows of its orders, described by
  ``part`` and located by ``supplier``'s nation.

Joins are left to the optimizer and AQE, which broadcast a table by its size;
only the keyword lexicon, a fixed table of this file, is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.tables import read

BOARD_PROFILE_ID = 0
BOARD_BASE_TS = "2024-01-01 06:00:00"


def _days_after(ts_literal: str, days: Column) -> Column:
    return F.timestamp_add("DAY", days, F.lit(ts_literal).cast("timestamp"))


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board listings as landed, one row per fetched document (URLs may repeat).

    ``arrival`` is the order of arrival inside the batch (the E1 tie order).
    """
    return board_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), read(spark, sf_dir, "nation"))


def board_rows(documents: DataFrame, labels: DataFrame, nation: DataFrame) -> DataFrame:
    """The board listing derivation; works on batch and streaming ``documents``."""
    d = documents.select("doc_id", "text", "lang", "source")
    lab = labels.select("doc_id", "quality", "toxic", F.lit(True).alias("labelled"))
    nat = nation.select("n_nationkey", "n_name")
    doc = F.col("doc_id")
    x = (d.join(lab, "doc_id", "left")
         .join(nat, (doc % 25) == F.col("n_nationkey")))
    posted_day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 60).cast("int")).cast("string")
    date_posted = (F.when(doc % 7 == 0, F.lit("nan"))
                   .when(doc % 11 == 0, F.lit(""))
                   .when(doc % 13 == 0, F.lit(None).cast("string"))
                   .when(doc % 6 == 5, F.concat(posted_day, F.lit("T10:00:00")))  # some boards post a time
                   .otherwise(posted_day))
    return x.select(
        doc.alias("id"),
        F.concat(F.lit("https://l.example/"), F.md5(F.col("text"))).alias("job_url"),
        F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias("title"),
        F.col("source").alias("employer"),
        F.col("n_name").alias("location"),
        F.col("text").alias("description"),
        F.col("lang").alias("language"),
        ((doc * 37) % 101).cast("int").alias("score"),
        (doc % 5 == 0).alias("is_remote"),
        F.when(doc % 4 == 0, "full_time").when(doc % 4 == 1, "part_time")
         .when(doc % 4 == 2, "contract").otherwise("").alias("job_type"),
        date_posted.alias("date_posted"),
        _days_after(BOARD_BASE_TS, (doc % 30).cast("int")).alias("discovered_at"),
        F.when(doc % 17 == 0, True).when(doc % 19 == 0, F.lit(None).cast("boolean"))
         .otherwise(False).alias("hidden"),
        F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1)
         .cast("int").alias("user_rating"),
        doc.alias("arrival"),
        F.coalesce("labelled", F.lit(False)).alias("labelled"),
    )


def board_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's ``jobs`` table: first arrival per URL wins (insert-or-ignore)."""
    from rankloom.operators.ranking import first_per_key
    return (first_per_key(listings_raw(spark, sf_dir), ["job_url"], [F.col("arrival")])
            .withColumn("profile_id", F.lit(BOARD_PROFILE_ID).cast("bigint")))


# Keyword lexicon per market segment for fleet profiles
# (boost weights positive, penalties negative).
SEGMENT_KEYWORDS = [
    ("AUTOMOBILE", "boost", "gear", 16.0), ("AUTOMOBILE", "boost", "bolt", 11.0),
    ("AUTOMOBILE", "penalize", "plate", -25.0),
    ("BUILDING", "boost", "anvil", 20.0), ("BUILDING", "boost", "rod", 9.0),
    ("BUILDING", "penalize", "gizmo", -35.0),
    ("FURNITURE", "boost", "widget", 12.0), ("FURNITURE", "boost", "red", 6.0),
    ("FURNITURE", "penalize", "cold", -50.0), ("FURNITURE", "penalize", "old", -10.0),
    ("HOUSEHOLD", "boost", "ring", 14.0), ("HOUSEHOLD", "boost", "small", 8.0),
    ("HOUSEHOLD", "penalize", "large", -20.0),
    ("MACHINERY", "boost", "gear", 18.0), ("MACHINERY", "boost", "promo", 5.0),
    ("MACHINERY", "boost", "gear", 3.0), ("MACHINERY", "penalize", "economy", -15.0),
]


def segment_keywords(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(SEGMENT_KEYWORDS)]
    return spark.createDataFrame(rows, "ord int, segment string, kind string, keyword string, weight double")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet profiles, one row per ``customer``, in the nested profile shape."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    kw = segment_keywords(spark)
    # keyword arrays per segment: a five-row fixed table, broadcast to the profiles
    def in_order(kind):
        items = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "keyword", "weight"))))
        return F.transform(items, lambda e: F.struct(e["keyword"].alias("keyword"), e["weight"].alias("weight")))

    lex = kw.groupBy("segment").agg(in_order("boost").alias("boost"), in_order("penalize").alias("penalize"))
    x = (c.join(n, c.c_nationkey == n.n_nationkey)
         .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
         .join(F.broadcast(lex), F.col("c_mktsegment") == F.col("segment"), "left"))
    return x.select(
        F.col("c_custkey").alias("profile_id"),
        F.concat(F.lit("Buyer in "), F.lower("c_mktsegment")).alias("resume"),
        F.col("c_name").alias("description"),
        F.lit(None).cast("string").alias("feedback_summary"),
        F.struct(
            F.array(F.lower("c_mktsegment")).alias("terms"),
            F.array(F.col("n_name"), F.col("r_name")).alias("locations"),
            F.lit(24).alias("hours_old"),
            F.lit(25).alias("results_per_site"),
            F.lit(None).cast("string").alias("require_language"),
            F.array(F.col("n_name")).alias("allowed_regions"),
        ).alias("search"),
        F.struct(F.coalesce("boost", F.array()).alias("boost"),
                 F.coalesce("penalize", F.array()).alias("penalize")).alias("scoring"),
        F.struct(
            F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 200).cast("int").alias("score_threshold"),
            F.lit(5).alias("max_jobs_per_email"),
            F.lit(7).alias("max_job_age_days"),
            F.lit(30).alias("rerank_candidates"),
            F.when(F.col("c_custkey") % 3 == 0, 0.5).when(F.col("c_custkey") % 3 == 1, 0.3).alias("rerank_min_score"),
            F.lit("UTC").alias("timezone"),
            F.lit("{count} new matches - top score {top_score}").alias("email_subject"),
            F.lit("{count} new jobs, best {top_score}").alias("telegram_message"),
        ).alias("notification"),
        F.col("c_mktsegment").alias("segment"),
    )


def fleet_url() -> Column:
    """A fleet listing's URL: (order, line, part, supplier) is the line item's unique key."""
    return F.concat_ws("/", F.lit("https://t.example"), F.col("l_orderkey").cast("string"),
                       F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                       F.col("l_suppkey").cast("string"))


def fleet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings fetched for every fleet profile, one per ``lineitem`` of its
    orders, with all that selection needs; ``fleet_details`` describes them."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate").repartition("l_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    # The jobs table is unique on URL, and the URL is the line item's key, so a
    # re-fetched line item keeps its first version. Line items are dealt by order
    # once: the orders join, this dedupe by the key columns and the look-up in the
    # ledger (dealt alike) all stay in place.
    from rankloom.operators.ranking import first_per_key
    x = first_per_key(li.join(o, li.l_orderkey == o.o_orderkey),
                      ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                      [F.col("l_shipdate"), F.col("l_linestatus"), F.col("l_returnflag")])
    return x.select(
        F.col("o_custkey").alias("profile_id"),
        fleet_url().alias("job_url"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 101)
        .cast("int").alias("score"),
        (F.col("l_linestatus") == "O").alias("is_remote"),
        F.replace(F.lower(F.expr("substring(o_orderpriority, 3)")), F.lit(" "), F.lit("-")).alias("job_type"),
        F.when(F.col("l_returnflag") == "R", F.lit("nan"))
         .otherwise(F.to_date("l_shipdate").cast("string")).alias("date_posted"),
        F.col("o_orderdate").cast("timestamp").alias("discovered_at"),
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
    )


def fleet_details(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` plus title, employer, location and description, by its part and
    supplier; selections come first, so that only the rows they leave are joined."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = (rows.join(p, F.col("l_partkey") == p.p_partkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey)
         .join(n, F.col("s_nationkey") == F.col("n_nationkey")))
    return x.select(
        *rows.columns, F.col("p_name").alias("title"), F.col("s_name").alias("employer"),
        F.col("n_name").alias("location"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("description"))


def fleet_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fleet listing with its description."""
    return fleet_details(spark, sf_dir, fleet_rows(spark, sf_dir))


FEEDBACK_KIND = {"purchase": "rate", "error": "rate", "click": "applied", "view": "note", "signup": "hide"}


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User actions as an append-only log ``(profile_id, listing_id, seq, ts, kind, value)``.

    purchase = like (+1), error = dislike (-1, or 0 = clear for small values),
    click = applied / not applied, view = note (empty note clears it), signup = hide / unhide.
    """
    return feedback_log(read(spark, sf_dir, "events"))


def feedback_log(events: DataFrame) -> DataFrame:
    """The event -> feedback mapping; works on batch and streaming ``events``."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    et = F.col("event_type")
    kind = F.when(et.isin("purchase", "error"), "rate").when(et == "click", "applied") \
        .when(et == "view", "note").when(et == "signup", "hide")
    value = (F.when(et == "purchase", F.when(F.col("value") > 48, "2").otherwise("1"))
             .when(et == "error", F.when(F.col("value") < 3, "0").otherwise("-1"))
             .when(et == "view", F.when(F.col("value") < 2, "")
                   .otherwise(F.concat(F.lit("note "), F.col("event_id").cast("string"))))
             .when(et == "signup", F.when(F.col("value") >= 20, "1").otherwise("0"))
             .when(et == "click", F.when(F.col("value") >= 10, "1").otherwise("0"))
             .otherwise("1"))
    return e.select(
        F.col("user_id").alias("profile_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("listing_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        value.alias("value"),
    )


def board_sent_ledger(spark: SparkSession, sf_dir: str, as_of: str, days_before: int = 7) -> DataFrame:
    """Board ledger ``(profile_id, job_url, sent_at)``: listings viewed more than
    ``days_before`` days before ``as_of``; the earliest view is the send time."""
    e = read(spark, sf_dir, "events").select("ts", "event_type", "props")
    cutoff = F.timestamp_add("DAY", F.lit(-days_before), F.lit(as_of).cast("timestamp"))
    views = (e.filter((F.col("event_type") == "view") & (F.col("ts").cast("timestamp") < cutoff))
             .select(F.get_json_object("props", "$.k").cast("bigint").alias("listing_id"),
                     F.col("ts").cast("timestamp").alias("ts")))
    jobs = board_jobs(spark, sf_dir).select("id", "job_url")
    return (views.join(jobs, views.listing_id == jobs.id)
            .groupBy("job_url").agg(F.min("ts").alias("sent_at"))
            .select(F.lit(BOARD_PROFILE_ID).cast("bigint").alias("profile_id"), "job_url", "sent_at"))


def fleet_sent_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet ledger: returned ('A') line items count as already mailed at their order date.
    Dealt by ``l_orderkey``, like ``fleet_rows``, which equal URLs share."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                "l_returnflag")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.filter(F.col("l_returnflag") == "A").repartition("l_orderkey")
            .join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("profile_id"),
                    fleet_url().alias("job_url"),
                    F.col("o_orderdate").cast("timestamp").alias("sent_at"), "l_orderkey"))


def raw_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board fetch rows as landed by the job-board fetcher, before normalisation.

    One row per document: ``site`` = its source, task = (language as search
    term, nation as search location). Missing values stay NULL: no remote flag
    for unlabelled documents, no job type for the empty one.
    """
    return fetched(listings_raw(spark, sf_dir))


def fetched(rows: DataFrame) -> DataFrame:
    """``board_rows`` as the fetcher lands them; works on batch and stream."""
    return rows.select(
        "id", "arrival", F.col("employer").alias("site"), F.col("language").alias("term"),
        F.col("location").alias("search_location"),
        "title", F.col("employer").alias("company"), "location", "job_url", "date_posted",
        F.when(F.col("labelled"), F.col("is_remote")).alias("is_remote"),
        F.nullif(F.col("job_type"), F.lit("")).alias("job_type"),
        "description", "discovered_at",
    )
