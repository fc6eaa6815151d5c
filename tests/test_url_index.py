"""The URL index: against a plain set, replays, and what a look-up reads as it grows."""

import os
import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from rankloom.sources.url_index import UrlIndex
from rankloom.streaming import streams as ST


def frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "job_url string")


def found(index, spark, urls, before=None):
    """The URLs of ``urls`` that the index holds."""
    have = {r.job_url for r in index.known(frame(spark, urls), before).collect()}
    return have & set(urls)


def test_like_a_set_through_merges_and_replays(spark):
    index, rng, stored = UrlIndex(spark, ST.run_dir(spark, "urls"), per_bucket=20, fan=3), random.Random(5), {}
    assert found(index, spark, ["a"]) == set()
    for version in range(11):
        batch = [f"https://x/{rng.randrange(300)}" for _ in range(rng.randrange(1, 60))] + [None, ""]
        seen = set().union(*stored.values())
        assert found(index, spark, batch, version) == set(batch) & seen
        index.add(frame(spark, batch), version)
        stored[version] = set(batch) - {None}
    assert len(index.runs()) < 7 and max(r.bits for r in index.runs()) >= 2
    again = ["https://x/other", None]
    index.add(frame(spark, again), 10)  # the last batch is replayed with other rows
    stored[10] = {"https://x/other"}
    every = [f"https://x/{k}" for k in range(300)] + ["", "https://x/other"]
    assert found(index, spark, every) == set().union(*stored.values())
    assert found(index, spark, every, 10) == set().union(*(stored[v] for v in range(10)))
    index.add(frame(spark, []), 11)
    assert found(index, spark, every) == set().union(*stored.values())


def test_a_write_that_broke_off_does_not_count(spark):
    index = UrlIndex(spark, ST.run_dir(spark, "urls"))
    index.add(frame(spark, ["a"]), 0)
    index.add(frame(spark, ["b"]), 1)
    os.remove(os.path.join(index.path, index.runs()[1].name, "_SUCCESS"))
    assert found(index, spark, ["a", "b"]) == {"a"}
    index.add(frame(spark, ["b", "c"]), 1)
    assert found(index, spark, ["a", "b", "c"]) == {"a", "b", "c"}


def size(paths):
    return sum(os.path.getsize(os.path.join(at, f)) for p in paths for at, _, files in os.walk(p) for f in files if f.endswith(".parquet"))


def test_reads_do_not_grow_with_what_is_stored(spark):
    """Three URLs are asked after 2 and after 20 batches of 2,000: ten times the rows are
    stored, the folders read grow by the number of runs only (2 and 5)."""
    index = UrlIndex(spark, ST.run_dir(spark, "urls"), per_bucket=250, fan=4)
    asked, read, whole = frame(spark, ["u/1", "u/2000", "none"]), {}, {}
    for version in range(20):
        index.add(spark.range(2000 * version, 2000 * version + 2000).select(F.concat(F.lit("u/"), "id").alias("job_url")), version)
        read[version + 1] = size(index.folders(asked))
        whole[version + 1] = size([os.path.join(index.path, r.name) for r in index.runs()])
    assert len(index.runs()) <= 8 and whole[20] > 8 * whole[2]
    assert read[20] < 3.5 * read[2] and read[20] < whole[20] / 8


def test_ingest_takes_every_url_once(spark, tmp_path):
    from conftest import SMALL
    for name in ("documents", "labels", "nation", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        both = df.unionByName(df) if name == "documents" else df  # every document lands twice
        both.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    index = UrlIndex(spark, ST.run_dir(spark, "urls"), per_bucket=10, fan=2)
    got = [r.job_url for r in ST.ingest_stream(spark, str(tmp_path), max_files=1, index=index).collect()]
    once = [r.job_url for r in ST.ingest_stream(spark, SMALL).collect()]
    assert sorted(got) == sorted(once) and len(set(got)) == len(got)
    assert sorted(r.job_url for r in index.known(frame(spark, got)).collect()) == sorted(got)


def test_scored_ingest_stream_is_cut_free(spark, tmp_path):
    from conftest import SMALL
    from rankloom.plans import ingest as IQ
    for name in ("documents", "labels", "nation", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    cols = ["profile_id", "job_url", "raw_score", "delta", "score"]
    whole = E.queries()["stream_ingest_scored"](spark, SMALL).select(*cols)
    cut = ST.ingest_stream(spark, str(tmp_path), IQ.BOARD_REGIONS, IQ.BOARD_LANGUAGE, 1,
                           lambda new: IQ.score_new(spark, str(tmp_path), new)).select(*cols)
    assert len(set(whole.columns)) == 5 and cut.select("profile_id", "job_url").distinct().count() == cut.count()
    assert {r.job_url for r in cut.collect()} <= {r.job_url for r in ST.ingest_stream(spark, SMALL).collect()}
