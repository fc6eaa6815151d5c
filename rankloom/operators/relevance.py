"""Term relevance of documents to queries (C5, J5, J13): a threshold join and the K best.

``weight(t) = round(100 * ln(N / df(t)))``, which falls to 0 for a term that all
documents have; ``matched`` is the weight of a query's terms that a document
holds, ``score = floor(100 * matched / total)``. With evidence (J13) a term's
weight is multiplied by how often the query repeats it.

The corpus is tokenized once into ``doc, terms`` (its distinct words that some
query uses). A query's terms are ordered by weight; ``upto`` is the weight of a
term and all lighter ones, the most that they can give together. A document that
holds only terms with ``upto`` below a bar stays below it, so only the other,
heavy terms are joined to find candidates and summed as they are joined (first
aggregate); a candidate that cannot reach the bar with all light terms goes, and
the light terms of the rest are looked up in the document's own array (second
aggregate). Frequent words are never joined through their postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.session import materialize

MIN_SCORE = 20  # default bar of ``relevance``: pairs below it are not produced
SEED_SHARE = 50  # per cent of a query's weight whose heavier half finds the first candidates of ``relevance_top``
SEED_DOCS = 40  # so many times k documents are matched exactly for the bar


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def query_terms(queries: DataFrame, q_id: str, q_text: str) -> DataFrame:
    """``q, term, tf``."""
    x = queries.select(F.col(q_id).alias("q"), F.explode(tokens(q_text)).alias("term"))
    return x.groupBy("q", "term").agg(F.count("*").alias("tf"))


def term_arrays(docs: DataFrame, d_id: str, d_text: str, vocabulary: DataFrame) -> DataFrame:
    """``doc, terms``: the distinct words of each document that are in ``vocabulary(term)``."""
    x = docs.select(F.col(d_id).alias("doc"), F.explode(F.array_distinct(tokens(d_text))).alias("term"))
    return (x.join(vocabulary.select("term").distinct(), "term", "left_semi")
            .groupBy("doc").agg(F.array_distinct(F.collect_list("term")).alias("terms")))


def term_weights(spark: SparkSession, arrays: DataFrame, docs: DataFrame, d_id: str) -> DataFrame:
    """``term, weight``. N enters as an uncorrelated scalar subquery: computed once, no join."""
    return spark.sql(
        """select term, cast(round(100 * ln((select count(*) from {docs}) / count(*))) as bigint) as weight
           from (select explode(terms) as term from {arrays}) group by term""",
        docs=docs.select(d_id), arrays=arrays)


def query_weights(qt: DataFrame, weights: DataFrame, variants) -> DataFrame:
    """``q, term`` and per variant ``w_, total_`` and ``upto_``; a window is one query's terms."""
    levels = {"plain": F.lit(1), "evidence": F.col("tf")}
    x = qt.join(weights, "term").select("q", "term", *[(F.col("weight") * levels[v]).alias(f"w_{v}") for v in variants])
    own = Window.partitionBy("q")
    for v in variants:
        x = x.withColumn(f"total_{v}", F.sum(f"w_{v}").over(own)).withColumn(
            f"upto_{v}", F.sum(f"w_{v}").over(own.orderBy(f"w_{v}", "term").rowsBetween(Window.unboundedPreceding, 0)))
    return x


def candidates(qw: DataFrame, arrays: DataFrame, variants) -> DataFrame:
    """First aggregate: ``q, doc, n_terms, m_<v>`` of the pairs that share a heavy
    term, by heavy terms alone. ``qw`` has ``bar_<v>``, the least weight asked for."""
    heavy = qw.filter(_heavy(variants)).select("q", "term", *[f"w_{v}" for v in variants])
    return (arrays.select("doc", F.explode("terms").alias("term")).join(heavy, "term").groupBy("q", "doc")
            .agg(F.count("*").alias("n_terms"), *[F.sum(f"w_{v}").alias(f"m_{v}") for v in variants]))


def _sum_of(terms: Column, weight: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda total, t: total + weight[t])


def _heavy(variants) -> Column:
    return _any([(F.col(f"w_{v}") > 0) & (F.col(f"upto_{v}") >= F.col(f"bar_{v}")) for v in variants])


def pairs_over(qw: DataFrame, arrays: DataFrame, variants) -> DataFrame:
    """``q, doc, n_terms, matched_<v>, total_<v>`` of all pairs that reach ``bar_<v>`` by one of the variants."""
    light = ~_heavy(variants)
    sums = qw.groupBy("q").agg(*[c for v in variants for c in (
        F.max(f"total_{v}").alias(f"total_{v}"), F.max(f"bar_{v}").alias(f"bar_{v}"),
        F.sum(F.when(light, F.col(f"w_{v}")).otherwise(0)).alias(f"rest_{v}"))])
    lists = qw.filter(light).groupBy("q").agg(
        F.collect_list("term").alias("light"),
        *[F.map_from_entries(F.collect_list(F.struct("term", f"w_{v}"))).alias(f"of_{v}") for v in variants])
    # A table of one row per query: its size is known when the joins are planned, so a small one is
    # broadcast. Left to the run, the pairs with their arrays would be dealt by query before that shows.
    own = materialize(sums.join(lists, "q", "left"), "query-lists")
    within = _any([F.col(f"m_{v}") + F.col(f"rest_{v}") >= F.col(f"bar_{v}") for v in variants])
    # dealt by document once: summing per (query, document) and looking the array up stay in place;
    # pairs move as numbers, the lists of terms come to those that are left
    by_doc = arrays.repartition("doc")
    x = candidates(qw, by_doc, variants).join(own.select(*sums.columns), "q").filter(within).join(by_doc, "doc").join(
        own.select(*lists.columns), "q")
    hit = F.coalesce(F.array_intersect("terms", "light"), F.array().cast("array<string>"))
    # a generator, so that the filter and the sums below share one intersection
    x = x.select("*", F.explode(F.array(hit)).alias("hit")).select(
        "q", "doc", (F.col("n_terms") + F.size("hit")).alias("n_terms"),
        *[c for v in variants for c in (
            (F.col(f"m_{v}") + _sum_of(F.col("hit"), F.col(f"of_{v}"))).alias(f"matched_{v}"), F.col(f"total_{v}"), F.col(f"bar_{v}"))])
    return x.filter(_any([F.col(f"matched_{v}") >= F.col(f"bar_{v}") for v in variants]))


def _weighted(spark, queries, q_id, q_text, docs, d_id, d_text, variants) -> tuple[DataFrame, DataFrame]:
    """The weighted query terms and the term arrays, the latter as a table that all steps read."""
    qt = query_terms(queries, q_id, q_text)
    arrays = materialize(term_arrays(docs, d_id, d_text, qt), "term-arrays")
    return query_weights(qt, term_weights(spark, arrays, docs, d_id), variants), arrays


def relevance_variants(spark: SparkSession, queries: DataFrame, q_id: str, q_text: str,
                       docs: DataFrame, d_id: str, d_text: str, variants=("plain", "evidence"),
                       min_score: int = MIN_SCORE, only: DataFrame | None = None) -> DataFrame:
    """J5 and J13 from one pass (``matched_<v>``, ``total_<v>``, ``score_<v>``): all
    pairs that reach ``min_score`` by one of the ``variants``. ``only`` (a frame
    with ``d_id``) limits the pairs to some documents; frequencies come from all."""
    qw, arrays = _weighted(spark, queries, q_id, q_text, docs, d_id, d_text, variants)
    qw = materialize(qw, "query-weights")
    # floor(100 m / t) >= bar is m >= ceil(bar t / 100) for whole numbers
    for v in variants:
        qw = qw.withColumn(f"bar_{v}", F.expr(f"({min_score} * total_{v} + 99) div 100"))
    if only is not None:
        arrays = arrays.join(only.select(F.col(d_id).alias("doc")).distinct(), "doc", "left_semi")
    out = pairs_over(qw, arrays, variants)
    for v in variants:
        share = F.floor(F.lit(100) * F.col(f"matched_{v}") / F.col(f"total_{v}")).cast("int")
        out = out.withColumn(f"score_{v}", F.when(F.col(f"total_{v}") > 0, share).otherwise(0))
    return out.select(F.col("q").alias(q_id), F.col("doc").alias(d_id), "n_terms",
                      *[f"{c}_{v}" for v in variants for c in ("matched", "total", "score")])


def relevance(spark: SparkSession, queries: DataFrame, q_id: str, q_text: str,
              docs: DataFrame, d_id: str, d_text: str, evidence: bool = False,
              min_score: int = MIN_SCORE, only: DataFrame | None = None) -> DataFrame:
    """J5 (J13 with ``evidence``): every pair with a score of ``min_score`` or more."""
    v = "evidence" if evidence else "plain"
    x = relevance_variants(spark, queries, q_id, q_text, docs, d_id, d_text, (v,), min_score, only)
    return x.select(q_id, d_id, "n_terms", F.col(f"matched_{v}").alias("matched"), F.col(f"total_{v}").alias("total"),
                    F.col(f"score_{v}").alias("score"))


def with_top_bars(qw: DataFrame, arrays: DataFrame, k: int) -> DataFrame:
    """``qw`` with ``bar_plain``: the k-th best match among the documents that hold
    most weight of the query's heaviest terms (at least a bound for the k-th best of
    all); 1, that is any weight, where there are fewer than k. The heavy weights
    alone choose ``SEED_DOCS`` times k documents, so only their arrays are looked up."""
    seeds = qw.withColumn("bar_plain", F.expr(f"({SEED_SHARE} * total_plain + 99) div 100"))
    heaviest = Window.partitionBy("q").orderBy(F.desc("m_plain"), "doc")
    chosen = candidates(seeds, arrays, ("plain",)).withColumn("r", F.row_number().over(heaviest)).filter(F.col("r") <= SEED_DOCS * k)
    found = _exact(materialize(chosen.select("q", "doc"), "seed-pairs"), qw, arrays)
    best = Window.partitionBy("q").orderBy(F.desc("matched_plain"))
    bars = (found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).groupBy("q")
            .agg(F.when(F.count("*") == k, F.min("matched_plain")).alias("bar_plain")))
    return qw.join(bars, "q", "left").withColumn("bar_plain", F.greatest(F.coalesce("bar_plain", F.lit(1)), F.lit(1)))


def _exact(pairs: DataFrame, qw: DataFrame, arrays: DataFrame) -> DataFrame:
    """``q, doc, matched_plain`` of given pairs."""
    weights = qw.groupBy("q").agg(F.collect_list("term").alias("own"),
                                  F.map_from_entries(F.collect_list(F.struct("term", "w_plain"))).alias("of"))
    return pairs.join(weights, "q").join(arrays, "doc").select(
        "q", "doc", _sum_of(F.array_intersect("terms", "own"), F.col("of")).alias("matched_plain"))


def relevance_top(spark: SparkSession, queries: DataFrame, q_id: str, q_text: str,
                  docs: DataFrame, d_id: str, d_text: str, k: int) -> DataFrame:
    """Each query's ``k`` documents with most matched weight (ties: smaller id),
    all with some weight if there are fewer: ``q_id, pos, d_id, matched, total, score``.

    Exact. Documents with one of a query's heaviest terms give a bar that the k
    best must reach, and the threshold join with that bar of the query's own does
    the rest, so pairs are formed for a small share of all documents only.
    """
    qw, arrays = _weighted(spark, queries, q_id, q_text, docs, d_id, d_text, ("plain",))
    qw = materialize(qw, "query-weights")
    found = pairs_over(materialize(with_top_bars(qw, arrays, k), "query-bars"), arrays, ("plain",))
    order = Window.partitionBy("q").orderBy(F.desc("matched_plain"), "doc")
    top = found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
    return top.select(F.col("q").alias(q_id), F.col("pos").cast("bigint").alias("pos"), F.col("doc").alias(d_id),
                      F.col("matched_plain").alias("matched"), F.col("total_plain").alias("total"),
                      F.floor(F.lit(100) * F.col("matched_plain") / F.col("total_plain")).cast("int").alias("score"))


def pair_relevance(spark: SparkSession, pairs: DataFrame, keys: list[str], q_text: str, d_text: str,
                   corpus: DataFrame, c_id: str, c_text: str) -> DataFrame:
    """J5 for given pairs (a cut, a labelled set): ``keys`` and ``score``. Term
    weights come from the whole ``corpus``; each pair stays one row until its
    query terms are looked up, so the work grows with the pairs alone."""
    has = F.array_distinct(tokens(d_text))
    x = pairs.select(*keys, F.explode(F.transform(F.array_distinct(tokens(q_text)), lambda t: F.struct(
        t.alias("term"), F.array_contains(has, t).alias("hit")))).alias("e")).select(*keys, "e.term", "e.hit")
    words = corpus.select(F.explode(F.array_distinct(tokens(c_text))).alias("term"))
    used = words.join(x.select("term").distinct(), "term", "left_semi").select(F.array("term").alias("terms"))
    g = x.join(term_weights(spark, used, corpus, c_id), "term").groupBy(*keys).agg(
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0)).alias("m"), F.sum("weight").alias("t"))
    return g.select(*keys, F.when(F.col("t") > 0, F.floor(F.lit(100) * F.col("m") / F.col("t"))).otherwise(0)
                    .cast("int").alias("score"))
