"""The versioned state table, sessions across batches and the insights trigger."""

import os
from datetime import datetime, timedelta

from rankloom.sources.state import StateTable
from rankloom.streaming import streams as ST


def held(table, before=None):
    return sorted(map(tuple, table.read(before).collect()), key=str)


def test_save_replace_clear_and_compaction(spark):
    t = StateTable(spark, ST.run_dir(spark, "state-test"), ["k"], "k long, v string", compact_every=3)
    row = lambda *r: spark.createDataFrame(list(r), "k long, v string, _deleted boolean")
    assert held(t) == []
    t.put(row((1, "a", False), (2, "b", False)), 0)
    t.put(row((1, "c", False)), 1)
    t.put(row((2, None, True)), 2)
    assert held(t) == [(1, "c")] and held(t, 1) == [(1, "a"), (2, "b")]
    t.put(row((2, "back", False), (None, "null key", False)), 3)  # compacts 0 to 2
    assert t.parts() == ([2], [3]) and held(t, 3) == [(1, "c")]
    want = [(1, "c"), (2, "back"), (None, "null key")]
    assert held(t) == sorted(want, key=str)
    t.put(row((2, "back", False), (None, "null key", False)), 3)  # a replayed batch
    assert held(t) == sorted(want, key=str)
    for v in range(4, 30):
        t.put(row((v % 5, str(v), False)), v)
        assert len(t.parts()[1]) <= 4
    assert {k: v for k, v in held(t) if k is not None} == {0: "25", 1: "26", 2: "27", 3: "28", 4: "29"}
    t.put(spark.createDataFrame([], "k long, v string"), 30)
    assert len(held(t)) == 6


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def landed(spark, root, files):
    """Event files in the order in which a stream takes them."""
    for n, rows in enumerate(files):
        path = os.path.join(root, "events.parquet")
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 60 * n,) * 2)
    return root


def test_sessions_bridge_and_equal_batch(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    minutes = [[0, 10, 100, 300], [75, 110, 500], [40, 70, 330], [1000, 20, 360]]  # 40 and 70 join 0 to 110; 330 and 360 run on
    files = [[(100 * f + k, at(m), 1, "view", 1.0, "{}") for k, m in enumerate(ms)] for f, ms in enumerate(minutes)]
    root = landed(spark, str(tmp_path), files)
    got = sorted(map(tuple, ST.session_stream(spark, root, "30 minutes", 1, compact_every=2).collect()))
    every = spark.read.parquet(f"{root}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type")
    want = sorted((r.event_type, r.window_start, r.window_end, r.n)
                  for r in ST.activity_counts(every, ["event_type"], kind="session", gap="30 minutes").collect())
    assert got == want == [("view", at(0), at(140), 8), ("view", at(300), at(390), 3), ("view", at(500), at(530), 1), ("view", at(1000), at(1030), 1)]
    assert sorted(map(tuple, ST.session_stream(spark, root, "30 minutes").collect())) == want


def test_insights_fire_once_per_ten_across_batches(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    like = lambda k, listing, value=9.0: (k, at(k), 1, "purchase", value, f'{{"k": "{listing}"}}')
    clear = lambda k, listing: (k, at(k), 1, "error", 1.0, f'{{"k": "{listing}"}}')
    files = [[like(k, k) for k in range(7)], [like(10 + k, 5 + k) for k in range(5)],  # ten listings after the second
             [clear(20, 0), clear(21, 1)], [like(30, 0), like(31, 1)],  # taken back and given again: nothing new
             [like(40 + k, 50 + k) for k in range(21)]]  # 31 in all: two more
    fired = []
    got = ST.insight_runs_stream(spark, landed(spark, str(tmp_path), files), 1, compact_every=2,
                                 on_run=lambda rows, b: fired.extend((b, r.profile_id, r.new_runs) for r in rows.collect()))
    assert fired == [(1, 1, 1), (4, 1, 2)]
    assert [tuple(r) for r in got.collect()] == [(1, 30, 3)]
