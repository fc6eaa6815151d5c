"""Drop lines that many documents share.

Lines are exploded as (row, position, digest of the normalised line); distinct
documents per digest are counted in two steps (distinct pairs, then a partial
count), so a line that a third of all documents hold is never gathered. The
digests over the threshold go back to the positions that hold them by a join
salted with the document, and every row drops its positions and is put together
again. Texts move once, keyed by row; lines move only as 16-byte digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankloom.llm.common import Scratch

SPACE = b" \t\n\r\x0b\f"  # \x20 \x09-\x0D
SALTS = 16


def line_key(line: bytes) -> bytes:
    """The line without \\x20 \\x09-\\x0D at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _lines(docs: DataFrame, min_points: int) -> DataFrame:
    """``doc_id, th, pos, key`` for every line with a key of ``min_points`` or more
    code points; th is the text's digest, which tells rows of one doc_id apart."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = kind or batch.schema.field("doc_id").type
            row, pos, keys = [], [], []

            def flush():
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("th").take(at),
                     pa.array(pos, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "th", "pos", "key"])

            for i, text in enumerate(batch.column("text")):
                for k, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_points and (min_points <= 1 or len(key.decode("utf-8", "replace")) >= min_points):
                        row.append(i)
                        pos.append(k)
                        keys.append(hashlib.md5(key, usedforsecurity=False).digest())
                if len(row) >= 200_000:
                    yield flush()
                    row, pos, keys = [], [], []
            if row:
                yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        exploded, f"doc_id {kind}, th bigint, pos int, key binary")


def _without(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    out = []
    for text, gone in zip(texts, dropped):
        lines = (text or "").split("\n")
        if gone is None or not len(gone):
            out.append((len(lines), 0, text or ""))
            continue
        keep = np.ones(len(lines), dtype=bool)
        keep[gone] = False
        out.append((len(lines), len(gone), "\n".join(x for x, k in zip(lines, keep.tolist()) if k)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if there) of the kept lines, plus
    ``n_lines`` (before) and ``n_dropped``, which replace columns of these names.

    A text is split at \\n; null and empty texts are one empty line and come back
    as the empty text. Lines whose key has ``min_points`` code points or more and
    stands in at least ``min_docs`` distinct doc_ids go from every document; rows
    without a doc_id count as one document. Repeated rows are all kept. Other
    columns are unchanged.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(_lines(docs, min_points), "lines")
    shared = (lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
              .groupBy("key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
              .select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    gone = (salted.join(shared, ["key", "salt"]).groupBy("doc_id", "th")
            .agg(F.collect_set("pos").alias("gone"))
            .select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = "_line_dedup"
    while out in rest:
        out += "_"
    rows = docs.select(*rest)
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"])
                     & (F.xxhash64(rows["text"]) == gone["gone_th"]), "left")
    done = pandas_udf(_without, "n_lines bigint, n_dropped bigint, text string")(rows["text"], gone["gone"])
    return both.withColumns({out: done}).select(
        *(F.col(f"{out}.text").alias(c) if c == "text" else
          F.length(f"{out}.text").cast("bigint").alias(c) if c == "n_chars" else rows[c] for c in rest),
        F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_dropped").alias("n_dropped"))
