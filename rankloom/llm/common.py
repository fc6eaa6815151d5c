"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared checkpoint folder.

    ``save`` writes a frame once and reads it back: lineage is cut at files all
    executors see, and a lost executor costs only the tasks that read them.
    ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a lambda a plain column expression would be evaluated again for each
    element; a lambda variable over a one-element array is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_array(values: Iterable[int], kind: str = "bigint") -> Column:
    """A constant array, folded from one string (no expression per element)."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def slices(texts: pd.Series, max_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_chars`` characters (or one row), covering all."""
    start = used = 0
    for i, n in enumerate(texts.str.len().fillna(0).astype("int64").tolist()):
        if i > start and used + n > max_chars:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(texts):
        yield start, len(texts)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_rankloom_cache", {}).setdefault(name, {})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_per_class: int) -> DataFrame:
    """``text, label, place`` of at most ``max_per_class`` labelled rows of each of
    the classes 0 and 1: those of the smallest hashes of doc_id. The ids are cut
    before any text is read; a doc_id labelled both ways counts as 1, rows
    without a label or id are left out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).alias("label"))
             .withColumn("place", F.xxhash64("doc_id", F.lit("sample"))))
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy("place", "doc_id").limit(max_per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    return texts.join(picked, "doc_id").select("text", F.col("label").cast("int").alias("label"), "place")
