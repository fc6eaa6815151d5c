"""Line dedup, SimHash, MinHash, packing and secrets against brute force, with edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import line_dedup, minhash, packing, secrets, simhash
from rankloom.llm.common import Scratch
from rankloom.llm.components import components

SCHEMA = "doc_id bigint, text string, score string, key string, salt string, gone string"


def docs_of(spark, rows):
    """(doc_id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["  Shared LINE ", "shared line", "\tshared line\r"]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1] + " more"), (104, "ein Wört ünd ß"),
             (105, "one two"), (106, "\n\n"), (107, "word " * 30_000), (None, "shared line\nlost"), (108, rows[7][1]),
             (108, rows[7][1])]
    return rows


def strip(line):
    return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup_brute_force(spark):
    rows = corpus()
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(strip(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (strip(x) and len(holders[strip(x)]) >= 10)]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text)
           for r in line_dedup.drop_shared_lines(docs_of(spark, rows), min_docs=10).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) >= 20


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark):
    docs = docs_of(spark, [(1, "a\na"), (2, "a")])
    out = line_dedup.drop_shared_lines(docs, min_docs=2)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert [(r.text, r.key) for r in out.orderBy("doc_id").collect()] == [("", "y"), ("", "y")]
    assert line_dedup.drop_shared_lines(docs.limit(0), min_docs=2).count() == 0


def reference_fp(text, words=3):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[k:k + words]) for k in range(max(len(parts) - words + 1, 1))] if parts else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_simhash_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 107]
    rng = random.Random(5)
    base = rows[3][1].split(" ")
    for i in range(200, 260):  # near copies, so that fingerprints a few bits apart occur
        copy = list(base)
        copy[rng.randrange(len(copy))] = "edit"
        rows.append((i, " ".join(copy)))
    fps = [(i, reference_fp(t)) for i, t in rows]
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(fps, 2) if bin(x ^ y).count("1") <= 3]
    label = reach(near, {i for i, _ in fps})
    assert len({x for _, x in fps if x}) > len(set(label.values()))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted((i, f"{x:016x}", label[i]) for i, x in fps)
    kept = simhash.keep_one(docs_of(spark, [*rows, (None, "x")]))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(
        [(False, i) for i in set(label.values())] + [(True, None)])
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("parts,distance", [(1, 2), (2, 3), (4, 3), (2, 5)])
def test_links_are_complete_for_any_thresholds(spark, parts, distance):
    rng = random.Random(parts)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in range(5) for _ in range(8)}
    fps |= {seeds[0] & ~0xFFFF | k for k in range(64)}  # many share a key
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(k, x) for k, x in enumerate(signed)], "node bigint, fp bigint")
    got = {tuple(sorted(r)) for r in simhash.links(nodes, Scratch(spark, "t"), distance, parts).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if bin(a ^ b).count("1") <= distance}
    assert got == want


def test_allocation_takes_the_cheapest_thresholds():
    rng = np.random.default_rng(1)
    cost = np.cumsum(rng.random((50, 3, 5)), axis=2)
    cost[:, :, 0] = 0
    got = simhash.allocate(cost, 1)
    for k in range(50):
        best = min(sum(cost[k, i, t + 1] for i, t in enumerate(ts))
                   for ts in itertools.product(range(-1, 4), repeat=3) if sum(ts) == 1)
        assert sum(got[k]) == 1 and np.isclose(best, sum(cost[k, i, t + 1] for i, t in enumerate(got[k])))


def test_components_of_a_long_path_and_empty(spark):
    path = [(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 50), (7, 7)]
    edges = spark.createDataFrame(path, "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 60: 50}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text.lower()) if x]
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))}


def test_minhash_edits_and_likeness(spark):
    rows = [r for r in corpus(40) if r[0] not in (None, 107)]
    rows = list(dict(rows).items())
    texts = [t or "" for _, t in sorted(rows)]
    got = {r.doc_id: r for r in minhash.compare_edits(docs_of(spark, rows)).collect()}
    errors = []
    for k, (i, _) in enumerate(sorted(rows)):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        edit = t[:len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edit), (got[i].near_next, after)):
            a, b = shingle_set(t), shingle_set(other)
            errors.append(near - len(a & b) / len(a | b))
    assert np.abs(errors).max() < 0.2 and np.abs(errors).mean() < 0.05
    assert got[102].fingerprint == got[5].fingerprint and len(got[5].fingerprint) == 128


def test_minhash_ties_nulls_and_empty(spark):
    docs = docs_of(spark, [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (None, "abcdefgh")])
    rows = minhash.compare_edits(docs).collect()
    assert sorted(r.n_chars for r in rows) == [0, 8, 15, 15]
    alone = next(r for r in rows if r.doc_id is None)
    assert alone.near_next is None and alone.edited_sha256 == hashlib.sha256(b"abcdef").hexdigest()
    assert minhash.compare_edits(docs.limit(0)).count() == 0


ODD = ["", "  a  b \n\n c ", "it's 'tis don't", "a　b c d", "tab\t\tx\n y ", "12 ab3 4c ½ ² Ⅷ", "日本語 テスト !!",
       "🙂 ok👍🏽 é", "<|endoftext|> x", "   ", "\n", "a \n b", "x​y", " lead", "trail ", "\r\n\r\nq", "don't stop"]


def test_packing_ids_and_windows(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    rows = list(dict(r for r in corpus(30) if r[0] is not None).items()) + [(500 + k, t) for k, t in enumerate(ODD)]
    pieces = packing.pack(docs_of(spark, rows).repartition(5), path).cache()
    got = {}
    for r in pieces.orderBy("sequence_id", "offset").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        want = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        mine = sorted(got[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == want
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens * 4 == len(want) for r in mine)
    places = [(r.sequence_id, r.offset, r.length) for r in pieces.orderBy("sequence_id", "offset").collect()]
    at = 0
    for s, o, n in places:
        assert s * 1024 + o == at and o + n <= 1024
        at += n
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert [r.n_tokens for r in whole[:-1]] == [1024] * (len(whole) - 1)
    assert all(len(r.ids) == 4096 for r in whole[:-1]) and len(whole[-1].ids) in (4096, 4 * whole[-1].n_tokens)
    assert packing.pack(docs_of(spark, rows).limit(0), path).count() == 0
    assert packing.pack(docs_of(spark, [(None, None), (1, "a"), (1, "a")]), path).count() == 3


def test_packing_keeps_large_ids_beside_nulls(spark):
    import public_tokenizers
    rows = [(2**53 + k if k % 3 else None, "a b c " * k) for k in range(1, 40)]
    for parts in (1, 4):
        pieces = packing.pack(docs_of(spark, rows).coalesce(1).repartition(parts), public_tokenizers.path("byte_bpe_50k.json"), length=64)
        assert sorted({r.doc_id for r in pieces.collect() if r.doc_id is not None}) == sorted(i for i, _ in rows if i)
        at = sorted((r.sequence_id * 64 + r.offset, r.length) for r in pieces.collect())
        assert [a for a, _ in at] == [0, *itertools.accumulate(n for _, n in at)][:-1]


def test_columns_of_any_name_and_type(spark):
    rows = [(1, "one two three four", {"a": 1}), (1, "one two three four", {"b": 2}), (2, "one two three four", None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, more map<string,int>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.more) for r in kept.collect())[1:] == [(1, {"a": 1})]
    clash = docs.withColumn("_line_dedup", F.lit(5)).withColumn("_line_dedup_", F.lit(6))
    out = line_dedup.drop_shared_lines(clash, min_docs=2)
    assert {(r["_line_dedup"], r["_line_dedup_"], r.text) for r in out.collect()} == {(5, 6, ""), (5, 6, "x")}


def test_packing_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    from rankloom.llm.queries import op5_packing
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>don't", " <|endoftext|>\n日本 <|endoftext", "plain", "", None,
             "x" * 9 + " <|endoftext|>  y" * 2000, *ODD]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    tool = Tokenizer.from_file(path)
    want = {i: [*tool.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 2124, 0]
    for r in op5_packing(spark, str(tmp_path)).collect():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())


BASE = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
         lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: m.end() - m.start() >= 16))


def base_spans(text):
    spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    return sorted(spans)


def test_secrets_base_spans_brute_force(spark):
    rng = random.Random(9)
    bits = ["password=", "Secret: \"", "api_key = '", "apikey:", "token=secret:abcdefghijklmnop", "AKIA", "AKIAQ2W3E4R5T6Y7U8", "é",
            "0123456789abcdef", "deadbeef", " ", "\n", "x", "ABCDEFGHIJKLMNOP", "🙂", "passwd", "=", "a.b-c_d/e+f=", "AKIAAKIA"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(200)]
    rows += [(900, None), (901, ""), (902, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"), (903, "a" * 100_000), (None, "password=abcdefghijkl")]
    found = secrets.scan(docs_of(spark, rows))
    got = sorted(((r.doc_id, [(x.s, x.k, x.e) for x in r.base]) for r in found.collect()), key=str)
    assert got == sorted(((i, base_spans(t or "")) for i, t in rows), key=str)
    assert secrets.scan(docs_of(spark, rows).limit(0)).count() == 0


def entropy(window):
    p = [window.count(c) / len(window) for c in set(window)]
    return -sum(x * np.log2(x) for x in p)


# the classes of windows that keys come in, first match counts, with their bars
CLASSES = [("hex", 3.0, "(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$"), ("upper", 3.4, "(?=(?:.*[0-9]){2})(?=(?:.*[A-Z]){2})[A-Z0-9]+$"),
           ("lower", 3.5, "(?=(?:.*[0-9]){2})(?=(?:.*[a-z]){2})[a-z0-9]+$"),
           ("letter", 3.7, "(?=(?:.*[a-z]){4})(?=(?:.*[A-Z]){4})[A-Za-z]+$"), ("mixed", 3.8, "(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")]


def brute_suspicious(run, n=20):
    has = lambda p: re.search(p, run)
    one_case = re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) and has("[a-fA-F]") and has("[0-9]")
    mixed = has("[0-9]") and has("[a-z]") and has("[A-Z]")
    plain = re.sub(secrets.UUID, r"\1\2\3\4\5", run)
    allowed = rf"(?i)[a-z0-9]{{0,{n}}}(?:{secrets.WORDS})[a-z0-9]{{0,{n}}}|{secrets.FILLER}"
    cuts = [0, *(x for m in re.finditer(allowed, plain) for x in m.span()), len(plain)]
    for piece in (plain[i:j] for i, j in zip(cuts[::2], cuts[1::2])):
        for k in range(len(piece) - n + 1):
            w = piece[k:k + n]
            bar = 3.0 if one_case else next((b for _, b, p in CLASSES if re.match(p, w)), 3.8 if mixed else None)
            if bar is not None and entropy(w) >= bar - 1e-9:
                return True
    return False


def test_added_spans_brute_force(spark):
    rng = random.Random(12)
    sets = ["0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz",
            "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789",
            secrets.LETTERS, "ab1", "aB", "/_-+"]
    words = ["example", "YOUR", "xxxxxxx", "0123456789", "aaaaaaaaa", "3f9c17be-0d24-4865-93a9-c17be0d25a86", "12345678", "Dummy"]
    runs = []
    for _ in range(900):
        parts = [rng.choice(words) if rng.random() < 0.15 else "".join(rng.choices(rng.choice(sets), k=rng.randint(1, 40)))
                 for _ in range(rng.randint(1, 4))]
        runs.append("".join(parts))
    runs = [r for r in runs if len(r) >= 20 and not base_spans(r)]
    got = added(spark, runs)
    want = {i: [(0, len(r))] if brute_suspicious(r) else [] for i, r in enumerate(runs)}
    assert got == want and 100 < sum(map(len, want.values())) < len(runs) - 100


def test_a_long_run_takes_seconds(spark):
    import time
    rng = random.Random(1)
    quiet = "".join(rng.choices("xyXY01", k=200_000))  # never near the bar of three kinds
    loud = "".join(rng.choices("xyz01", k=1_000_000)) + "/Zk3vT9qLm2Xw8RbY5nHc7Jd"
    begin = time.time()
    assert added(spark, [quiet, loud, "x" * 1_000_000]) == {0: [], 1: [(0, len(loud))], 2: []}
    assert time.time() - begin < 120


def test_added_spans(spark):
    runs = ["Zk3vT9qLm2Xw8RbY5nHc7Jd"]
    texts = [(1, f"see {runs[0]} here"), (2, "plain thheblehetioningreanderand words"), (3, "key EXAMPLE3vT9qLm2Xw8RbY5nHc7Jd end"),
             (4, f"token={runs[0]}"), (5, "id F3A9C17BE0D24865F3A9C17B")]
    added = {r.doc_id: [(x.s, x.e) for x in r.extra] for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert added == {1: [(4, 27)], 2: [], 3: [], 4: [], 5: [(3, 27)]}
    every = secrets.scan(docs_of(spark, texts[:1])).select(secrets.joined(F.concat("base", "extra")).alias("s")).first().s
    assert every == "entropy:4:27"


def added(spark, texts):
    rows = secrets.scan(docs_of(spark, list(enumerate(texts)))).collect()
    return {r.doc_id: [(x.s, x.e) for x in r.extra] for r in rows}


def test_secrets_of_every_class(spark):
    keys = ["k3j9x0q8w7z6v5u4t3s2p1", "JBSWY3DPEHPK3PXPJBSWY3DP", "QzRmTkWpLxHvBnGdYsJcFa", "3f9c17be-0d24-4865-93a9-c17be0d25a86",
            "3F9C17BE-0D24-4865-93A9-C17BE0D25A86", "ID_F3A9C17BE0D24865F3A9C17B", "Id-F3A9C17BE0D24865F3A9C17B",
            "IdF3A9C17BE0D24865F3A9C17B", "Zk3vT9qLm2/Xw8RbY5nHc7Jd+"]
    assert added(spark, [f"see {k} here" for k in keys]) == {i: [(4, 4 + len(k))] for i, k in enumerate(keys)}
    words = ["einungtzheitgeungverlich", "Einungtzheitgeungverlich", "EINUNGTZHEITGEUNGVERLICH", "some-words-in-a-slug-2024",
             "getElementsByClassName", "aaaabbbb1111aaaabbbb1111aaaa", "----------------------", "path/to/some_file_name"]
    assert added(spark, words) == {i: [] for i in range(len(words))}
    assert added(spark, ["xz1" * 10_000 + "/k3j9x0q8w7z6v5u4t3s2p1"]) == {0: [(0, 30_023)]}


def test_placeholders_hide_only_themselves(spark):
    key = "Zk3vT9qLm2Xw8RbY5nHc7Jd"
    shown = [f"sample/{key}", f"{key}-example", f"xxxxxxxx{key}", f"{key}/12345678", f"your_{key}", f"aaaaaaaa+{key}",
             "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW", f"example{'q' * 20}{key}"]
    assert added(spark, shown) == {i: [(0, len(t))] for i, t in enumerate(shown)}
    hidden = [f"example{key[:20]}", f"{key[:20]}EXAMPLE", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaA1", "your_api_key_goes_here",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    assert added(spark, hidden) == {i: [] for i in range(len(hidden))}
