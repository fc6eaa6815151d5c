"""Readers for landed fetch files (JSON lines, CSV, XML feeds, parquet).

Each job-board or feed source lands files under its own folder; the reader
applies an explicit schema (no inference), keeps unparseable records in a
``_corrupt_record`` column instead of failing the job, skips unreadable files,
and tags rows with their ``site``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def read_landed(spark: SparkSession, path: str, fmt: str, schema: StructType, site: str | None = None,
                row_tag: str = "item") -> DataFrame:
    """Read one source's landed files with ``schema``; ``fmt`` is json, csv, xml or parquet."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if fmt in ("json", "csv", "xml"):
        schema = StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    if fmt == "xml":
        reader = reader.option("rowTag", row_tag)
    df = reader.schema(schema).format(fmt).load(path)
    if site is not None:
        df = df.withColumn("site", F.lit(site))
    return df


def good_and_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed rows from quarantined raw records."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())
