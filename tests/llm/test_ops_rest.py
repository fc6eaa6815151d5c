"""Containment, licences, chat, the two classifiers and the registered queries."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from conftest import SMALL
from rankloom.llm import chat, containment, license_texts, licenses, quality, toxicity
from rankloom.llm.license_texts import MIT
from rankloom.llm.queries import ORACLE_SQL, QUERIES
from rankloom.llm.words import scan
from test_oracle import _digest


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    assert _digest(QUERIES[name](spark, SMALL).toPandas()) == _digest(duck.execute(ORACLE_SQL[name]).df())


def test_all_are_registered():
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)", q)[1]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(ORACLE_SQL) <= set(E.oracle_sql())


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(ws, k):
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}


def test_containment_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 60)))) for k in range(25)]
    items += [(30, "two words"), (31, ""), (32, None), (33, "!!!"), (None, items[0][1]), (34, items[0][1])]
    rows = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(25)][1].split()
            part = part[: rng.randint(len(part) // 2, len(part))]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        rows.append((i, " ".join(text)))
    rows += [(90, None), (91, ""), (92, "here Two, words stand"), (93, rows[0][1]), (93, rows[0][1]), (None, items[0][1])]
    want = set()
    for j, it in items:
        if j is None or not words(it):
            continue
        k = min(5, len(words(it)))
        own = shingles(words(it), k)
        for i, t in rows:
            shared = len(own & shingles(words(t), k)) if i is not None else 0
            if shared and shared / len(own) >= 0.8:
                want.add((i, j, len(own), shared, shared / len(own)))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, h string, n string")
    table = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id bigint, text string, w string")
    got = [tuple(r) for r in containment.contained(docs, table).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    left = containment.drop_contaminated(docs, table)
    assert left.columns == docs.columns
    assert left.count() == sum(1 for i, _ in rows if i not in {w[0] for w in want})
    assert containment.contained(docs.limit(0), table).count() == 0
    assert containment.contained(docs, table.limit(0)).count() == 0


def test_filter_is_sized_by_its_items(spark):
    assert [containment.table_bits(n) for n in (0, 1, 4096, 4097, 10**6)] == [1 << 16, 1 << 16, 1 << 16, 1 << 17, 1 << 24]
    for n in (5_000, 1_000_000):
        bits = containment.table_bits(n)
        cells = containment.bit_table(spark.range(n).select(F.xxhash64("id").alias("h")), bits)
        own, foreign = (spark.range(a, a + 5_000).select(F.avg(containment.listed(cells, F.xxhash64("id"), bits).cast("int")))
                        .first()[0] for a in (0, 10**9))
        assert own == 1 and foreign < 0.02


def test_signature_never_misses():
    for n in range(1, 300):
        upper = 2 ** int(np.ceil(np.log2(n)))
        k = int(upper - np.ceil(upper * 0.8 - 1e-9) + 1)
        assert k >= n - int(np.ceil(0.8 * n - 1e-9)) + 1


def test_license_forms(spark):
    from rankloom.llm.license_texts import MIT
    shouted = "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(",", " ;").replace("\n", "  \n ")
    rows = [(1, MIT), (2, shouted), (3, MIT + "and more"), (4, "text\n  licenced UNDER cc by-nc 4.0!\nmore"), (5, None), (6, ""),
            (7, "\n© 2019 x\n"), (4, "text"), (None, "Released under the MIT License"), (8, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id bigint, text string, digest string, notices string")
    got = licenses.scan(docs, licenses.known_digests(spark)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.license_id for r in got if r.license_id} == {1: "MIT", 2: "MIT", None: "MIT"}
    assert {(r.doc_id, r.notices) for r in got if r.notices} == {(4, "CC-BY-NC-4.0"), (None, "MIT")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in got if r.canonical_sha256 == empty} == {5, 6, 7}
    assert licenses.scan(docs.limit(0), licenses.known_digests(spark)).count() == 0


def wrapped(text, width=None, mark="", tail=""):
    """Each paragraph in lines of at most ``width`` characters, or one line, behind a comment mark."""
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    lines = [line for p in parts for line in [*(textwrap.wrap(p, width, break_on_hyphens=False) if width else [p]), ""]]
    return "\n".join(f"{mark}{line}{tail}" for line in lines)


def test_license_forms_do_not_depend_on_lines(spark):
    rows, want = [], {}

    def add(text, license_id):
        rows.append((len(rows), text))
        if license_id:
            want[len(rows) - 1] = license_id

    heads = ["", "Copyright (c) 2020, Some One and others\n\n", "© 2019-2021 Someone. All rights reserved.\n\n",
             "Copyright The Some Authors\nAll rights reserved.\n\n", "Copyright 2001 A\n(c) 2002 B\n\n"]
    for license_id, text in licenses.KNOWN:
        if len(text) > 200:
            for width in (*range(58, 101), None):
                add(heads[len(rows) % len(heads)] + wrapped(text, width), license_id)
            for mark in ("# ", " * ", "// ", ";; ", "-- "):
                for head in heads:
                    add(wrapped(head + text, 70, mark), license_id)
            add(" ".join((heads[1] + text).split()), license_id)  # all on one line
    add("MIT License Copyright (c) 2020 Someone " + " ".join(MIT.split()), "MIT")
    add("copyright notice and this permission notice", None)
    add("Copyright (c) 2020 Someone " + "own words " * 30, None)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = licenses.scan(docs, licenses.known_digests(spark)).collect()
    assert {r.doc_id: r.license_id for r in got if r.license_id} == want
    assert hashlib.sha256(b"").hexdigest() not in {r.canonical_sha256 for r in got}


def test_statements_of_any_length_and_titles(spark):
    names = [" ".join(f"Holder{k}" for k in range(n)) for n in (1, 10, 40, 400)]
    heads = [f"{part}Copyright (c) 2020 {n}\n\n" for n in names for part in ("", "Portions ", "Parts of this software are ")]
    heads += [f"Copyright {n}\n\n" for n in names] + [f"(c) {n}\n\n" for n in names]
    heads += [f"{title}\n\nCopyright (c) 2020 {names[2]}\n\n" for title in ("The MIT License", "MIT License", "MIT", "The MIT License (MIT)", "Expat License")]
    rows = [(h + MIT, "MIT") for h in heads] + [(f"The MIT License Copyright (c) 2020 {names[2]} " + " ".join(MIT.split()), "MIT")]
    for license_id, title in (("ISC", "The ISC License"), ("BSD-3-Clause", "The 3-Clause License"), ("BSD-3-Clause", "New BSD License"),
                              ("BSD-2-Clause", "BSD 2-Clause License"), ("Zlib", "The zlib License"), ("Unlicense", "The Unlicense")):
        text = license_texts.UNTITLED[license_id][0]
        rows.append((f"{title}\n\nCopyright 2001-2020 {names[1]}\n\n{text}", None if "3-Clause License" == title[4:] else license_id))
    rows += [("Portions of the work\n\n" + MIT, None), ("Copyright notice must stay\n\n" + MIT, None)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert got == {k: i for k, (_, i) in enumerate(rows)}


def test_every_license_has_text_and_notices(spark):
    from rankloom.llm.license_texts import NAMES, all_known
    whole = [(i, t) for i, t in all_known() if len(t) > 200]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {i for i, _ in whole}
    rows = [(i, f(t)) for i, t in whole for f in (str, str.upper, lambda t: wrapped(t, 66), lambda t: wrapped(t, 90, "# "), wrapped,
                                                  lambda t: "Copyright (c) 2020 Someone\n\n" + t)]
    notes = [(i, f"x\n# SPDX-License-Identifier: {i}\ny") for i in NAMES] + [(i, f"x\nLicensed under the {n}.") for i, ns in NAMES.items() for n in ns]
    docs = spark.createDataFrame(list(enumerate(t for _, t in rows + notes)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert len(got) == len(rows + notes)
    assert [got[k].license_id for k in range(len(rows))] == [i for i, _ in rows]
    assert [got[len(rows) + k].notices for k in range(len(notes))] == [i for i, _ in notes]


def test_chat_escape_round_trip():
    rng = random.Random(4)
    bits = ["<", "[", "\\", "|", "/", "s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "a", "<|/|>", "<|user|>", "\n", "]", ">"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not re.search(rf"[<\[](?={chat.TAIL})", safe)
        assert chat.read_turns(chat._mark("a|b/\\") + safe + chat.END) == [("a|b/\\", text)]


def test_chat_examples(spark):
    rows = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", "<|assistant|>x"), (1, 2, "user", None), (1, 3, "assistant", "yes"),
            (1, 4, "user", "bye"), (2, 0, "user", "alone"), (3, 0, None, ""), (3, None, "assistant", "first"),
            (None, 0, "assistant", "z"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, example string")
    out = chat.expand(turns).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.example)
    assert [r.text[r.loss_start:r.loss_end] for r in one] == ["hi <\\/s>", "yes", ""]
    assert one[1].text.startswith(one[0].text) and one[2].text.startswith(one[1].text)
    got = {r.conv_id: r for r in chat.digests(chat.expand(turns)).collect()}
    said = "user\n<|assistant|>x\nassistant\nhi </s>\nuser\n\nassistant\nyes\nuser\nbye\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 5
    assert got[1].loss_sha256 == hashlib.sha256(b"hi </s>yes").hexdigest() and got[1].loss_chars == 10
    assert got[1].formatted_chars == sum(len(r.text) for r in one)
    assert (got[2].n_turns, got[2].loss_chars, got[3].n_turns, got[4].n_turns, got[4].loss_chars, got[None].n_turns) == (1, 0, 2, 2, 8, 1)
    assert chat.expand(turns.limit(0)).count() == 0


def test_chat_ids_beside_nulls(spark):
    big = 2**53
    rows = [(big + k, t, r, f"{k} {t}") for k in range(4) for t, r in enumerate(("user", "assistant"))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", "y"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    got = chat.digests(chat.expand(turns)).collect()
    assert sorted(r.conv_id for r in got if r.conv_id is not None) == [big + k for k in range(4)]
    assert {r.n_turns for r in got if r.conv_id is not None} == {2}
    alone = [r for r in got if r.conv_id is None]
    assert [r.n_turns for r in alone] == [1] * 4 and sum(r.loss_chars for r in alone) == 2


def brute_marginals(e, trans, start):
    import itertools
    n, total, one = len(e), 0.0, np.zeros(len(e))
    for path in itertools.product((0, 1), repeat=n):
        s = start[path[0]] + sum(e[k] for k in range(n) if path[k]) + sum(trans[a][b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        one += np.exp(s) * np.array(path)
    return one / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 7, 2, 1, 6]
    opens = np.concatenate([[True] + [False] * (n - 1) for n in sizes])
    e, trans, start = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2)), rng.normal(size=2)
    want, at = [], 0
    for n in sizes:
        want.append(brute_marginals(e[at:at + n], trans, start))
        at += n
    assert np.allclose(toxicity.marginals(e, opens, trans, start), np.concatenate(want))


def test_long_chains_are_whole():
    rng = np.random.default_rng(2)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [3, 700, 1, toxicity.LONG_CHAIN, toxicity.LONG_CHAIN - 1, 2000]
    opens = np.concatenate([[True, *[False] * (n - 1)] for n in sizes])
    e = rng.normal(size=len(opens)) * 3
    got = toxicity.marginals(e, opens, trans, start)
    want, at = [], 0
    for n in sizes:  # scaled recursion of each chain, in probabilities
        x = np.exp(np.stack([np.zeros(n), e[at:at + n]], axis=1))
        fore, back = np.empty((n, 2)), np.ones((n, 2))
        fore[0] = np.exp(start) * x[0]
        for t in range(1, n):
            fore[t] = fore[t - 1] / fore[t - 1].sum() @ np.exp(trans) * x[t]
        for t in range(n - 2, -1, -1):
            back[t] = np.exp(trans) @ (back[t + 1] * x[t + 1])
            back[t] /= back[t].sum()
        both = fore * back
        want.append(both[:, 1] / both.sum(axis=1))
        at += n
    assert np.allclose(got, np.concatenate(want), atol=1e-9)


def test_transitions_of_long_sentences_are_learnt():
    rng = np.random.default_rng(3)
    spell = lambda k: " ".join(["bad"] * k)  # noqa: E731  toxic words come in spells inside one endless sentence
    texts = [" ".join(rng.choice(["the", "on", "of", spell(40)]) for _ in range(300)) for _ in range(4)]
    words = scan(texts)
    y = np.array([float(words.forms[c] == "bad") for c in words.code])
    assert words.opens.sum() == 4
    seen = np.array([[((y[:-1] == i) & (y[1:] == j) & ~words.opens[1:]).sum() for j in (0, 1)] for i in (0, 1)])
    fitted = toxicity.fit_chain(words, y, rounds=60).trans
    assert seen.sum() == len(y) - 4  # every neighbouring pair counts in the fit
    assert fitted[1, 1] + fitted[0, 0] > fitted[0, 1] + fitted[1, 0]


def test_word_scan():
    texts = ["Hello  wörld. foo", "", "a_b 12!x", "🙂 é", "  "]
    w = scan(texts)
    want = [(r, m.start(), m.end(), m[0]) for r, t in enumerate(texts) for m in re.finditer(r"\w+", t)]
    assert [(r, a, b, w.forms[c]) for r, a, b, c in zip(w.row, w.start, w.end, w.code)] == want
    assert w.opens.tolist() == [True, False, True, True, False, True, True]


def labelled(spark, kind):
    rng = random.Random(1)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows, labels = [], []
    for i in range(240):
        ws = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        if bad and kind == "toxic":
            for _ in range(4):
                ws[rng.randrange(len(ws))] = rng.choice(["zzgrub", "zzgrubber", "vilekin"])
        if bad and kind == "quality":
            ws = [ws[0]] * len(ws) if i % 8 else [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws) + ".", "x", "y"))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(500, None, "x", "y"), (501, "", "x", "y"), (None, "zzgrub vilekin zzgrub", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tox string, label string")
    return docs, spark.createDataFrame(labels, f"doc_id bigint, {kind} int")


def test_toxicity_learns_and_tags(spark):
    docs, labels = labelled(spark, "toxic")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if i % 3 == 1]
    assert np.mean([(got[i].tox.score >= 0.7) == bool(truth[i]) for i in held]) >= 0.97
    spans = [got[0].text[x.start:x.end] for x in got[0].tox.spans]
    assert spans and all(w in ("zzgrub", "zzgrubber", "vilekin") for s in spans for w in s.split())
    assert got[500].tox.score == got[501].tox.score < 0.7 <= got[None].tox.score
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and 500 in {r.doc_id for r in clean.collect()}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).where("tox.score >= 0.7").count() == 0


def test_quality_learns_by_pairs(spark):
    docs, labels = labelled(spark, "quality")
    model = quality.train(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if i % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(truth[i]) for i in held]) >= 0.95
    assert got[500] == got[501] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == docs.count()


def test_held_out_accuracy_on_the_landed_tables(spark):
    larger = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    for name, label in (("op1_toxicity", "toxic"), ("op6_quality_classifier", "quality")):
        rows = QUERIES[name](spark, larger).join(labels, "doc_id").where("held_out")
        right = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert right >= 0.97, name


def test_pipeline_stages_step_by_step(spark, tmp_path):
    """Each stage against what its own rule says about its own input."""
    docs, kept = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
            kept.append({r.doc_id: r.text for r in out.select("doc_id", "text").collect()})
        docs = out
    toxic, lines, unlike, clean = kept
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(i in toxic for i, t in labels.items() if t == 0)
    assert set(lines) == set(toxic) and all(len(lines[i]) <= len(toxic[i] or "") for i in lines)
    assert set(unlike) < set(lines)
    items = [shingles(words(r.text), 5) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        own = shingles(words(text), 5)
        return any(len(own & it) / len(it) >= 0.8 for it in items if it)
    assert {i for i, t in unlike.items() if not leaks(t)} == set(clean)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(clean)
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
