"""C6 for listings that many profiles share: substring search by an index of q-grams.

Per-row keyword arrays (``scoring.keyword_delta``) serve listings that were
fetched for one profile. Where all profiles meet all listings, each distinct
keyword is searched once: a listing that contains a keyword holds all runs of
``q`` characters of it, so the rarest of these finds the candidates by an equi
join, and ``contains`` on the text itself decides. Keywords shorter than ``q``
are their own gram. Profiles with equal keyword lists are one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import clamp
from rankloom.operators.scoring import ENTITY_BOOST_CAP
from rankloom.session import materialize

Q = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters, from one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def keyword_hits(listings: DataFrame, id_col: str, text_col: str, keywords: DataFrame) -> DataFrame:
    """``id_col, keyword`` for every keyword (of ``keywords(keyword)``, in lower
    case) that a listing's text contains in any case. Null and empty keywords are
    passed over, spaces count like any character; rows that share an id are
    listings of their own, told apart by their text; repeated rows count once."""
    kw = (keywords.select(F.lower("keyword").alias("keyword")).where(F.coalesce("keyword", F.lit("")) != "").distinct()
          .withColumn("n", F.least(F.length("keyword"), F.lit(Q))))
    sizes = sorted(r.n for r in kw.select("n").distinct().collect())  # 1..Q
    none = F.array().cast("array<string>")
    per_size = none
    for n in sizes:
        per_size = F.when(F.col("n") == n, grams(F.col("keyword"), n)).otherwise(per_size)
    own = kw.select("keyword", F.explode(per_size).alias("gram"))
    rows = listings.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("text is not null")
    held = rows.select("id", F.explode(F.concat(none, *[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    # one row per listing: only grams that some keyword has
    index = materialize(held.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("id")
                        .agg(F.array_distinct(F.collect_list("gram")).alias("grams")), "keyword-grams")
    postings = index.select("id", F.explode("grams").alias("gram"))
    df = postings.groupBy("gram").agg(F.count("*").alias("df"))
    probe = (own.join(df, "gram", "left").groupBy("keyword")
             .agg(F.count("*").alias("own"), F.count("df").alias("known"),
                  F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
             .where("own = known").select("keyword", "gram"))
    asked = postings.join(probe, "gram").groupBy("id").agg(F.collect_set("keyword").alias("asked"))
    return (rows.join(asked, "id")
            .select("id", F.explode(F.filter("asked", lambda k: F.contains(F.col("text"), k))).alias("keyword"))
            .distinct().withColumnRenamed("id", id_col))


def keyword_classes(profiles: DataFrame) -> DataFrame:
    """``class_id, profile_id``: profiles whose boost and penalty lists are equal have
    the smallest profile_id among them as their class."""
    lists = F.to_json(F.struct(F.coalesce("boost", F.array()).alias("b"), F.coalesce("penalize", F.array()).alias("p")))
    x = profiles.select("profile_id", F.sha2(lists, 256).alias("_lists"))
    first = x.groupBy("_lists").agg(F.min("profile_id").alias("class_id"))
    return x.join(first, "_lists").select("class_id", "profile_id")


def shared_deltas(listings: DataFrame, id_col: str, text_col: str, profiles: DataFrame) -> DataFrame:
    """D8 of shared listings: ``class_id, id_col, n_hits, delta`` for every class of
    ``profiles(profile_id, boost, penalize)`` and listing with a keyword in it; all
    other pairs have a delta of 0. A keyword listed twice counts twice."""
    lead = keyword_classes(profiles).select("class_id").distinct()
    mine = profiles.join(lead, profiles["profile_id"] == lead["class_id"], "left_semi")
    weights = mine.select(F.col("profile_id").alias("class_id"), F.explode(F.concat(
        F.coalesce("boost", F.array()), F.coalesce("penalize", F.array()))).alias("k"))
    weights = (weights.select("class_id", F.lower("k.keyword").alias("keyword"), F.coalesce("k.weight", F.lit(0.0)).alias("w"))
               .where(F.coalesce("keyword", F.lit("")) != "")
               .groupBy("class_id", "keyword").agg(F.sum("w").alias("w"), F.count("*").alias("times")))
    hits = keyword_hits(listings, id_col, text_col, weights)
    return (hits.join(weights, "keyword").groupBy("class_id", id_col)
            .agg(F.sum("times").alias("n_hits"), F.sum("w").alias("raw"))
            .select("class_id", id_col, "n_hits", clamp("raw", -ENTITY_BOOST_CAP, ENTITY_BOOST_CAP).alias("delta")))
