"""Keyword suggestions: tasks are cut by the terms that they hold."""

import re

from rankloom.operators import proposals as P


def test_suggestions_are_parted_by_their_terms(spark, monkeypatch):
    rows = [(p, 1 if k % 3 else -1, f"word{k % 7} other{k} plain") for p in range(1, 9) for k in range(12)]
    rated = spark.createDataFrame(rows, "profile_id bigint, user_rating int, title string")
    people = spark.createDataFrame([(p, ([("word1", 1.0)], [])) for p in range(1, 9)],
                                   "profile_id bigint, scoring struct<boost:array<struct<keyword:string,weight:double>>,"
                                   "penalize:array<struct<keyword:string,weight:double>>>")
    whole = P.suggest_keywords(rated, people)
    monkeypatch.setattr(P, "TERMS_PER_TASK", 20)
    parted = P.suggest_keywords(rated, people)
    plan = parted._jdf.queryExecution().executedPlan().toString()
    # 8 profiles x 12 titles x 2 terms (digits part words) at 20 a task, in parts that are kept as given
    parts = {int(n) for n in re.findall(r"hashpartitioning\(profile_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert parts and min(parts) >= 8
    key = lambda r: tuple(map(str, r))
    assert sorted(whole.collect(), key=key) == sorted(parted.collect(), key=key) and whole.count() > 8
