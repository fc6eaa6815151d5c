"""J8, first set-up: search titles, boost and penalty keywords mined from a resume.

* boosts: the resume's words by ``tf * ln(N / df)``, the contrast to the corpus;
* titles: its neighbouring words as phrases, by how much more often documents
  hold the phrase than the two words' own frequencies let expect (PMI);
* penalties: the corpus' most common words that neither the resume nor its best
  listings hold, so nothing of the candidate's own is ever penalised.

Measures are whole numbers, so ties are real ties and go by the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import bound, tokens
from rankloom.operators import relevance as R
from rankloom.session import materialize

MIN_LETTERS = 3
TITLES, BOOSTS, PENALTIES = 12, 20, 10
BEST_LISTINGS = 5


def _long(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) >= MIN_LETTERS)


def phrases(text) -> Column:
    """Neighbouring words of MIN_LETTERS or more, joined by a space, with repeats."""
    def pairs(w: Column) -> Column:
        at = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        both = F.filter(at, lambda i: (F.length(F.get(w, i)) >= MIN_LETTERS) & (F.length(F.get(w, i + 1)) >= MIN_LETTERS))
        return F.transform(both, lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))

    return bound(tokens(text), pairs)


def _holders(docs: DataFrame, d_text: str, sought: DataFrame) -> DataFrame:
    """``phrase, both``: how many rows of ``docs`` hold each phrase of ``sought``. Neighbours
    become rows as they are; only the phrases sought are then counted once per row."""
    ahead = F.greatest(F.size("w") - 1, F.lit(0))
    near = docs.select(F.monotonically_increasing_id().alias("row"), tokens(d_text).alias("w")).select(
        "row", F.explode(F.arrays_zip(F.slice("w", F.lit(1), ahead).alias("a"), F.slice("w", F.lit(2), ahead).alias("b"))).alias("n"))
    both = near.where((F.length("n.a") >= MIN_LETTERS) & (F.length("n.b") >= MIN_LETTERS)).select(
        "row", F.concat("n.a", F.lit(" "), "n.b").alias("phrase"))
    return (both.join(sought, "phrase", "left_semi").groupBy("row", "phrase").agg(F.lit(1))
            .groupBy("phrase").agg(F.count("*").alias("both")))


def _ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each ``q`` with their rank; a window is one resume's words."""
    w = Window.partitionBy("q").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def suggest_from_resumes(spark: SparkSession, resumes: DataFrame, r_id: str, r_text: str,
                         docs: DataFrame, d_id: str, d_text: str) -> DataFrame:
    """``r_id, kind, rank, keyword, weight`` for every resume: up to 12 titles (weight
    0), 20 boosts (20 down to 1) and 10 penalties (-50 up to -14), fewer where a
    resume or the corpus has fewer words. ``docs`` is the corpus and the listings."""
    words = materialize(docs.select(F.explode(F.array_distinct(_long(tokens(d_text)))).alias("word"))
                        .groupBy("word").agg(F.count("*").alias("df")), "corpus-words")
    n = docs.count()
    # What the resumes say is written, so that its size is known when the joins are planned: the
    # corpus' words, and below its phrases and texts, are then cut down to it where they are.
    used = materialize(resumes.select(F.col(r_id).alias("q"), F.explode(_long(tokens(r_text))).alias("word"))
                       .groupBy("q", "word").agg(F.count("*").alias("tf")), "resume-words")
    found = words.join(used.select("word").distinct(), "word", "left_semi")
    own = materialize(used.join(found, "word", "left").na.fill(0, ["df"]), "resume-words-df")
    contrast = F.col("tf") * F.round(1000 * F.ln(F.lit(n + 1) / (F.col("df") + 1))).cast("bigint")
    boosts = _ranked(own.withColumn("s", contrast), [F.desc("s"), F.col("word")], BOOSTS).select(
        "q", F.lit("boost").alias("kind"), "rank", F.col("word").alias("keyword"), (F.lit(BOOSTS + 1) - F.col("rank")).alias("weight"))

    said = materialize(resumes.select(F.col(r_id).alias("q"), F.explode(phrases(F.col(r_text))).alias("phrase"))
                       .groupBy("q", "phrase").agg(F.count("*").alias("tf")), "resume-phrases")
    held = _holders(docs, d_text, said.select("phrase").distinct())
    dfs = own.select("word", "df").distinct()  # a phrase's words are words of its resume
    first, second = dfs.toDF("a", "df_a"), dfs.toDF("b", "df_b")
    rated = (said.withColumn("a", F.split_part("phrase", F.lit(" "), F.lit(1))).withColumn("b", F.split_part("phrase", F.lit(" "), F.lit(2)))
             .join(held, "phrase", "left").join(first, "a", "left").join(second, "b", "left").na.fill(0, ["both", "df_a", "df_b"]))
    pmi = F.round(1000 * F.ln((F.col("both") + 1) * F.lit(float(n)) / ((F.col("df_a") + 1) * (F.col("df_b") + 1)))).cast("bigint")
    titles = _ranked(rated.withColumn("s", pmi), [F.desc("s"), F.desc("tf"), F.col("phrase")], TITLES).select(
        "q", F.lit("title").alias("kind"), "rank", F.initcap("phrase").alias("keyword"), F.lit(0).alias("weight"))
    return (boosts.unionByName(titles).unionByName(_penalties(spark, resumes, r_id, r_text, docs, d_id, d_text, words, own))
            .withColumnRenamed("q", r_id).withColumn("rank", F.col("rank").cast("bigint")))


def _penalties(spark, resumes, r_id, r_text, docs, d_id, d_text, words, own) -> DataFrame:
    best = materialize(R.relevance_top(spark, resumes, r_id, r_text, docs, d_id, d_text, BEST_LISTINGS).select(
        F.col(r_id).alias("q"), F.col(d_id).alias("doc")), "best-listings")
    # only the best listings are split into words
    theirs = (docs.select(F.col(d_id).alias("doc"), F.col(d_text).alias("text")).join(best, "doc")
              .select("q", F.explode(F.array_distinct(_long(tokens("text")))).alias("word")))
    spared = materialize(own.select("q", "word").unionByName(theirs).distinct(), "spared-words")
    # as many common words as the largest set of spared ones could take away
    most = spared.groupBy("q").count().agg(F.max("count")).first()[0] or 0
    common = materialize(words.orderBy(F.desc("df"), "word").limit(most + PENALTIES)
                         .withColumn("place", F.row_number().over(Window.orderBy(F.desc("df"), "word"))), "common-words")
    taken = spared.join(common, "word").groupBy("q").agg(F.collect_list("place").alias("taken"))
    none = F.array().cast("array<int>")
    every = resumes.select(F.col(r_id).alias("q")).distinct().join(taken, "q", "left").select(
        "q", F.coalesce("taken", none).alias("taken"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.size("taken") + PENALTIES), "taken"), 1, PENALTIES)
    return (every.select("q", F.posexplode(free).alias("at", "place")).join(common, "place")
            .select("q", F.lit("penalize").alias("kind"), (F.col("at") + 1).alias("rank"), F.col("word").alias("keyword"),
                    (F.lit(-50) + 4 * F.col("at")).alias("weight")))
