"""Readers for the landed parquet tables.

Readers only name the file; Catalyst prunes columns and pushes filters into the
parquet scan from whatever the caller selects downstream.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A5: a missing ledger/state path means an empty table of the given schema."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def has_subdirs(spark: SparkSession, path: str, prefix: str) -> bool:
    """Whether ``path`` (any Hadoop file system) holds an entry named ``prefix*``."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return False
    return any(st.getPath().getName().startswith(prefix) for st in fs.listStatus(jvm_path))


def align_to(df: DataFrame, schema) -> DataFrame:
    """Bring ``df`` to ``schema``: missing columns become typed NULLs,
    existing ones are cast, extra ones are dropped (an evolved table can still
    be appended to, and old files read with ``mergeSchema``)."""
    from pyspark.sql import functions as F
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Two tables expose the same set of column names."""
    return set(a.columns) == set(b.columns)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: a write that broke off has no _SUCCESS."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
