"""Every registered query against its DuckDB oracle on sf0.001 (the driver's
gate runs the same comparison on sf0.01)."""

import hashlib

import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SMALL

from rankloom.plans.catalog import load

# the queries of this library alone; optional subpackages test their own
QUERIES = {name: run for name, run in E.queries().items() if name in load()}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in load()}


def _norm(v):
    if v is None or (isinstance(v, float) and pd.isna(v)):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(round(v, 6))
    return str(v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert _digest(got) == _digest(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["profile_id", "pos", "job_url", "title", "company", "location", "score", "date_posted"]
    assert df.count() >= 0


def test_scorer_hook_takes_a_callable(spark):
    import pandas as pd
    from rankloom.operators.scoring import batch_score
    req = spark.createDataFrame([(1, "u", "a b", "a"), (2, "v", "c", None)],
                                "profile_id long, job_url string, resume string, description string")
    own = batch_score(req, lambda b: pd.DataFrame({"score": [1.0] * len(b), "reason": ["mine"] * len(b)}))
    assert {r.reason for r in own.collect()} == {"mine"}
    assert {r.profile_id: r.score for r in batch_score(req).collect()} == {1: 50.0, 2: 0.0}
