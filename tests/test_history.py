"""Pages of a history: every page of small views against a plain sort."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.operators import history as H

SHAPE = "job_url string, score int, date_posted string, discovered_at timestamp"


def listings(spark, n):
    at = datetime(2024, 1, 1)
    day = lambda k: None if k % 7 == 0 else "not a day" if k % 11 == 0 else f"2024-01-{1 + k % 3:02d}"
    rows = [(f"u{k:04d}", None if k % 13 == 0 else k % 4, day(k), None if k % 5 == 0 else at + timedelta(days=k % 2)) for k in range(n)]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.mark.parametrize("sort", ["score", "posted", "discovered", None])
def test_pages_together_are_the_sort(spark, sort):
    rows = listings(spark, 203)
    want = [r.job_url for r in rows.orderBy(*H.sort_columns(sort)).collect()]
    view = H.Pages(rows, sort, page_size=10)
    assert (view.total, view.pages) == (203, 21)
    for number in (1, 2, 9, 20, 21):
        got = sorted(view.page(number).collect(), key=lambda r: r.pos)
        assert [r.job_url for r in got] == want[(number - 1) * 10:number * 10]
        assert [r.pos for r in got] == list(range((number - 1) * 10 + 1, min(number * 10, 203) + 1))
        assert {(r.total, r.pages, r.page) for r in got} == {(203, 21, number)}
    assert {r.page for r in view.page(-3).collect()} == {1} and {r.page for r in view.page(99).collect()} == {21}


def test_a_deep_page_reads_its_ranges_only(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        view = H.Pages(listings(spark, 400), "score", page_size=10)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert view.ranges.count() > 3
    want = listings(spark, 400).orderBy(*H.sort_columns("score")).collect()[380:390]
    assert [r.job_url for r in sorted(view.page(39).collect(), key=lambda r: r.pos)] == [r.job_url for r in want]
    read = view.page(39).select(F.input_file_name().alias("f")).distinct().count()
    assert 1 <= read <= 2
    plan = view.page(39)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range", plan)


def test_empty_view_and_repeated_rows(spark):
    empty = H.Pages(listings(spark, 203).limit(0), "score")
    assert (empty.total, empty.pages) == (0, 1) and empty.page(5).collect() == []
    assert set(empty.page(1).columns) >= {"pos", "total", "pages", "page", "job_url"}
    twice = listings(spark, 30)
    view = H.Pages(twice.unionByName(twice), "posted", page_size=25)
    got = [r for n in (1, 2, 3) for r in view.page(n).collect()]
    assert sorted(r.pos for r in got) == list(range(1, 61))
