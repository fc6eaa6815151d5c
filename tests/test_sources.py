"""Landed-file readers, schema alignment and parity, mail decoding."""

import os
import tempfile

from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankloom.operators.replies import decode_text
from rankloom.sources.landed import good_and_bad, read_landed
from rankloom.sources.tables import align_to, read_or_empty, same_columns

FETCH = StructType([StructField("title", StringType()), StructField("job_url", StringType()),
                    StructField("company", StringType())])


def test_json_lines_with_a_bad_record(spark):
    d = tempfile.mkdtemp(prefix="landed-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"title": "A", "job_url": "u1", "company": "x"}\n{broken\n{"title": "B", "job_url": "u2"}\n')
    good, bad = good_and_bad(read_landed(spark, d, "json", FETCH, site="board"))
    assert sorted(r.job_url for r in good.collect()) == ["u1", "u2"]
    assert len(bad.collect()) == 1 and set(good.columns) == {"title", "job_url", "company", "site"}


def test_xml_feed(spark):
    d = tempfile.mkdtemp(prefix="landed-")
    with open(os.path.join(d, "feed.xml"), "w") as f:
        f.write("<rss><item><title>T1</title><job_url>u1</job_url></item>"
                "<item><title>T2</title><job_url>u2</job_url><company>c</company></item></rss>")
    good, _ = good_and_bad(read_landed(spark, d, "xml", FETCH, site="feed", row_tag="item"))
    assert sorted((r.title, r.company) for r in good.collect()) == [("T1", None), ("T2", "c")]


def test_csv_with_quotes_line_ends_and_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="landed-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('title,job_url,company\n"Two\nlines, ""quoted""",u1,x\nshort,u2\n"",u3,\nA,u4,y,extra\n')
    good, bad = good_and_bad(read_landed(spark, d, "csv", FETCH, site="board").cache())
    assert {r.job_url: (r.title, r.company) for r in good.collect()} == {
        "u1": ('Two\nlines, "quoted"', "x"), "u3": (None, None)}
    assert len(bad.collect()) == 2  # too few and too many fields
    assert set(good.columns) == {"title", "job_url", "company", "site"}


def test_parquet_and_an_empty_folder(spark):
    d = tempfile.mkdtemp(prefix="landed-")
    spark.createDataFrame([("T", "u1", None)], FETCH).write.mode("overwrite").parquet(d)
    good, bad = good_and_bad(read_landed(spark, d, "parquet", FETCH, site="board"))
    assert [tuple(r) for r in good.collect()] == [("T", "u1", None, "board")] and bad.count() == 0
    empty = tempfile.mkdtemp(prefix="landed-")
    assert read_landed(spark, empty, "csv", FETCH).count() == 0


def test_align_and_parity(spark):
    df = spark.createDataFrame([("t", "u")], "title string, job_url string")
    target = StructType([StructField("id", LongType()), StructField("job_url", StringType())])
    out = align_to(df, target)
    assert out.schema == target and out.first().id is None
    assert same_columns(out, spark.createDataFrame([], target))
    assert not same_columns(out, df)


def test_missing_ledger_is_empty(spark):
    schema = StructType([StructField("job_url", StringType())])
    assert read_or_empty(spark, os.path.join(tempfile.mkdtemp(), "nope"), schema).count() == 0


def test_decode_charsets(spark):
    df = spark.createDataFrame([(bytearray("héllo".encode("utf-8")), None),
                                (bytearray("héllo".encode("latin-1")), "iso-8859-1")], "b binary, cs string")
    assert [r.t for r in df.select(decode_text("b", "cs").alias("t")).collect()] == ["héllo", "héllo"]


def test_encoded_headers_read_like_pythons(spark):
    from email.header import decode_header
    from rankloom.operators.replies import decode_header as decode
    raw = ["plain", "=?utf-8?B?R3LDvMOfZQ==?=", "=?iso-8859-1?Q?Caf=E9_au_lait?= now", "Re: =?UTF-8?q?=E2=82=AC_5?= =?latin1?B?6Q==?= end",
           "=?utf-8?b?w6k=?=\r\n =?utf-8?Q?=C3=A8?=", "a =?us-ascii?Q?b?= c =?us-ascii?Q?d?= e", "=?utf-8?Q??=", "", "2 =? 3 ?= 4"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k long, r string").select("k", decode("r").alias("t")).collect()
    read = lambda h: "".join(p if isinstance(p, str) else p.decode(c or "ascii") for p, c in decode_header(h))
    assert {r.k: r.t for r in rows} == {k: read(r) for k, r in enumerate(raw)}
    odd = spark.createDataFrame([("=?utf-8?B?***?= x",), (None,)], "r string").select(decode("r").alias("t")).collect()
    assert [r.t for r in odd] == ["=?utf-8?B?***?= x", ""]
