"""Filter audit, exact top-k and periodic runs against brute force, with edge cases."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import filter_audit, periodic, queries, vector_topk


# ---- periodic runs

def brute_runs(w, min_length, min_periods):
    found = set()
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(min_length, min_periods * q):
                part = w[i:i + n]
                if not any(all(part[k] == part[k + r] for k in range(n - r)) for r in range(1, q)):
                    found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        words += [rng.randrange(letters) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
    return words[:n]


def test_runs_equal_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(6000):
        words = repetitive(rng, rng.randint(0, 70), rng.randint(1, 4))
        for low in (1, 6, 24):
            want = brute_runs(words, low, 3)
            assert periodic.runs_of(words, low, 3) == want
            seen += len(want)
    assert seen > 10_000


def test_runs_nested_and_touching():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    inner = list("aab" * 4 + "c")
    for words in (list(fibonacci[-1]), inner * 5, ["a"] * 40 + ["b"] * 40, list("ab" * 20 + "ba" * 20)):
        for low in (1, 24):
            assert periodic.runs_of(words, low, 3) == brute_runs(words, low, 3)
    with pytest.raises(ValueError):
        periodic.runs_of(list("abab"), 1, 2)


def test_a_long_text_is_linear():
    assert periodic.runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    rng = random.Random(1)
    unit = [rng.randrange(50) for _ in range(40_000)]
    assert periodic.runs_of(unit * 4) == [(0, 160_000, 40_000)]


def test_periodic_runs_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{x}" for x in repetitive(rng, rng.randint(0, 200), 3))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "x " * 50_000), (204, "one"), (None, "a b " * 20),
             (205, rows[0][1]), (205, rows[0][1]), (206, "é ü x " * 30), (2**60 + 1, "a " * 30)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, start string, n_runs int")
    out = periodic.periodic_runs(docs, edit=periodic.planted)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        n = len(words)
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words, 24, 3) if n < 1000 else [(0, n, 1)]
        gone = set()
        for s, m, q in runs:
            gone.update(range(s + q, s + m))
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
                     sha(b" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# ---- filter audit

def test_adjacent_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filter_audit.adjacent_swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) and sum(1 for _ in filter_audit.adjacent_swaps(n)) == len(seen) - 1


def brute_audit(counts, letters):
    def steps(order):
        for k, f in enumerate(order):
            here = lambda c, m: c if m >> f & 1 and not any(m >> e & 1 for e in order[:k]) else 0
            kept = sum(c[0] for m, c in counts.items() if not any(m >> e & 1 for e in order[:k + 1]))
            removed, good, toxic = (sum(here(c[j], m) for m, c in counts.items()) for j in range(3))
            failing = sum(c[0] for m, c in counts.items() if m >> f & 1)
            yield f, kept, removed, failing - removed, counts.get(1 << f, (0,))[0], good, toxic

    every = [(o, list(steps(o))) for o in itertools.permutations(range(len(letters)))]
    shapley = {f: sum(s[2] for _, steps in every for s in steps if s[0] == f) for f in range(len(letters))}
    return {("".join(letters[f] for f in o), k, *s[1:], shapley[s[0]]) for o, some in every for k, s in enumerate(some, 1)}


def test_diagram_equals_brute_force():
    rng = random.Random(4)
    for letters in ("A", "ABC", "ABCDE"):
        for _ in range(25):
            counts = {m: (n := rng.randint(1, 9), rng.randint(0, n), rng.randint(0, n))
                      for m in range(1 << len(letters)) if rng.random() < rng.choice((0.1, 0.5, 1))}
            got = filter_audit.audit_orders(counts, letters)
            assert len(got) == len(letters) * math.factorial(len(letters)) == len(set(got))
            assert set(got) == brute_audit(counts, letters)


def test_equal_halves_share_a_node():
    diagram = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5, 3)
    assert diagram.root[1] is diagram.root[2] and diagram.root[1][1] is diagram.root[1][2]


def test_filters_on_texts(spark):
    words = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame(
        [(1, words, "en", 1), (2, words, "de", 1), (3, words, None, 1), (3, words, "", 1), (None, words, "en", 1),
         (4, None, "en", 1), (5, "", "en", 1), (6, "a " * 150, "en", 1), (7, words + " A|B", "en", 1),
         (8, "ABCDE " * 3 + words, "en", 1), (9, "x" * 3_000_000, "en", 1)],
        "doc_id bigint, text string, lang string, mask int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, 1, 1), (None, 1, 1), (9, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.mask): (r.n, r.good, r.toxic)
           for r in filter_audit.document_masks(docs, labels, F.col("lang")).collect()}
    assert got == {("en", 0): (3, 1, 1), ("de", 16): (1, 0, 0), ("", 16): (2, 0, 0), ("en", 1): (2, 0, 0),
                   ("en", 17): (1, 0, 0), ("en", 2): (1, 1, 1), ("en", 8): (1, 0, 0)}
    out = filter_audit.audit(filter_audit.document_masks(docs, labels, F.col("lang")), "ABCDE")
    assert out.count() == 3 * 600
    assert filter_audit.audit(filter_audit.document_masks(docs.limit(0), labels, F.col("lang")), "ABCDE").count() == 0


def test_words_are_counted_in_pieces():
    text = b" ".join(b"w%d" % (i % 700) for i in range(5000))
    for size in (1, 7, 100, 10**6):
        assert filter_audit._distinct_words(text, size) == (5000, 700)


# ---- exact top-k

def brute_top(rows, k):
    held = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((at, i, [math.floor(256 * x) for x in v]))
    out = set()
    for q, query in {(i, tuple(v)) for _, i, v in held if i is not None and i % 50 == 0}:
        some = [(-sum(a * b for a, b in zip(query, v)), i is None, i or 0, i, at)
                for at, i, v in held if i != q and len(v) == len(query)]
        out |= {(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(some, key=lambda x: x[:3])[:k], 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    rows = [(i, list(map(float, rng.normal(size=16) / 4))) for i in range(600)]
    rows += [(i, list(map(float, one))) for i in range(600, 900)]  # one vector of a third of the rows
    rows += [(i, list(map(float, one + rng.normal(size=16) / 300))) for i in range(900, 1000)]  # near copies of it
    rows += [(1000, None), (1050, [float("nan")] * 16), (1100, [1.0, None] * 8), (1150, [float("inf")] * 16),
             (1200, [0.5] * 3), (1201, [0.25] * 3), (1250, []), (1251, []), (None, [9.0] * 16), (-50, [1.0] * 16),
             (1300, [1e30, -1e30]), (1301, [1e30, 0.0]), (7, rows[7][1]), (7, rows[7][1]), (50, rows[50][1]),
             (100, rows[101][1])]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows],
                                  "vec_id bigint, embedding array<double>, v string, q int, slot int")
    got = vector_topk.top_k(frame, F.col("vec_id") % 50 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = [tuple(r) for r in got.collect()]
    bound = vector_topk.limit_of(2)
    assert sorted(r[2:] for r in found if r[0] == 1300) == [(1301, bound * bound)]
    want = {r for r in brute_top(rows, 5) if r[0] != 1300}
    assert {r for r in found if r[0] != 1300} == want
    assert len([r for r in found if r[0] != 1300 and r[0] != 100]) == len([r for r in want if r[0] != 100])
    assert vector_topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-90, 90, size=(4000, 32))
    queries = rng.integers(-90, 90, size=(40, 32))
    for bits in (1, 4, 6, 8):
        va = vector_topk.VAFile(vectors, list(range(4000)), bits)
        low, high = va.bounds(slice(0, 4000), queries.astype(float))
        exact = va.exact @ queries.T
        assert (low <= exact).all() and (exact <= high).all()
    read = [len(places) for places, _ in vector_topk.VAFile(vectors, list(range(4000)), 6)._scan(queries.astype(float), 6)]
    assert max(read) < 400


def test_registered_queries(spark):
    assert {"op11_filter_audit", "op12_exact_topk", "op13_periodic_runs"} <= set(queries.QUERIES)
    assert {"op11_filter_audit", "op12_exact_topk"} <= set(queries.ORACLE_SQL)
