"""Positional answers, minimum relevance and the fallback chain."""

from pyspark.sql import functions as F

from rankloom.operators import rerank as RR
from rankloom.operators.ranking import top_n_per_group
from rankloom.plans.rerank import numbered


def _cands(spark):
    return spark.createDataFrame([(1, i, f"u{i}", 0.3) for i in range(3)],
                                 "profile_id long, idx int, job_url string, rerank_min_score double")


def _order(df):
    return [r.job_url for r in df.orderBy("order_key").collect()]


def test_answer_a_order_and_drop(spark):
    ans = spark.createDataFrame([(1, 0, 2, 0.9), (1, 1, 0, 0.8), (1, 2, 1, 0.5)],
                                "profile_id long, resp_pos int, index long, relevance_score double")
    assert _order(RR.positional_a(_cands(spark), ans)) == ["u2", "u0", "u1"]
    low = spark.createDataFrame([(1, 0, 2, 0.1), (1, 1, -3, None)],
                                "profile_id long, resp_pos int, index long, relevance_score double")
    assert RR.positional_a(_cands(spark), low).count() == 0


def test_answer_b_skips_bad_indexes(spark):
    ans = spark.createDataFrame([(1, [2, 0, 7, 1], [0.9, 0.8])], "profile_id long, ranked array<int>, scores array<double>")
    got = RR.positional_b(_cands(spark), ans)
    assert _order(got) == ["u2", "u0", "u1"]  # 7 skipped, missing score counts 1.0


def test_fallback_asymmetry(spark):
    score = _cands(spark).select("profile_id", F.col("idx").alias("order_key"), "job_url")
    schema = "profile_id long, order_key int, job_url string"
    empty = spark.createDataFrame([], schema)
    b = spark.createDataFrame([(1, 0, "u1")], schema)
    answered = spark.createDataFrame([(1,)], "profile_id long")
    none = spark.createDataFrame([], "profile_id long")
    # A answered with nothing kept: A wins (empty digest), B is not consulted
    assert RR.fallback(score, empty, answered, b).count() == 0
    # A silent, B kept something: B
    assert [r.source for r in RR.fallback(score, empty, none, b).collect()] == ["B"]
    # both silent: score order
    assert {r.source for r in RR.fallback(score, empty, none, empty).collect()} == {"score"}


def test_salted_top_n_equals_plain_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1009).alias("v"), "id")
    n = F.when(F.col("g") == 0, 5).otherwise(3)
    a = top_n_per_group(df.withColumn("n", n), ["g"], [F.col("v").desc(), F.col("id")], F.col("n"), salt_buckets=16)
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    b = df.withColumn("n", n).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("n"))
    assert sorted(a.select("g", "id", "rank").collect()) == sorted(b.select("g", "id", "rank").collect())


ANSWER = "profile_id long, resp_pos int, index long, relevance_score double"


def test_a_bad_index_fails_its_own_profile_only(spark):
    cands = spark.createDataFrame([(p, i, f"u{p}{i}", 0.3) for p in range(1, 5) for i in range(3)],
                                  "profile_id long, idx int, job_url string, rerank_min_score double")
    ans = spark.createDataFrame([(1, 0, 2, 0.9), (2, 0, 3, 0.9), (2, 1, 0, 0.9), (3, 0, None, 0.9), (4, 0, -4, 0.9)], ANSWER)
    assert [r.job_url for r in RR.positional_a(cands, ans).collect()] == ["u12"]
    assert [r.profile_id for r in RR.usable_a(cands, ans).collect()] == [1]


def test_long_lists_and_duplicate_answers_are_kept_whole(spark):
    cands = spark.createDataFrame([(1, i, f"u{i}", 0.5) for i in range(45)],
                                  "profile_id long, idx int, job_url string, rerank_min_score double")
    ans = spark.createDataFrame([(1, k, k % 45, 0.6 if k % 2 else 0.4) for k in range(90)], ANSWER)
    got = RR.positional_a(cands, ans)
    assert got.count() == 45  # those at the profile's own minimum, repeats too
    assert numbered(got, ["profile_id"], ["order_key"]).agg(F.max("pos")).first()[0] == 45
