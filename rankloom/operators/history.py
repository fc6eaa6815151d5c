"""History views over one profile's listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rankloom.operators import filters as B
from rankloom.operators.ranking import sort_columns
from rankloom.session import materialize, table_dir

PAGE_SIZE = 25


def with_sent(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Left join the ledger; ``sent`` = a send time exists."""
    led = ledger.select("profile_id", "job_url", "sent_at")
    return jobs.join(led, ["profile_id", "job_url"], "left").withColumn("sent", F.col("sent_at").isNotNull())


def select_history(rows: DataFrame, q: str | None = None, filter_name: str | None = None,
                   sent_day: str | None = None) -> DataFrame:
    """B6 + B9 + B8 + B10: visible rows, text search, filter enum, sent-day prefix
    (the day applies only with the ``sent`` filter)."""
    x = rows.filter(B.visible("hidden") & B.text_search(q, "title", "employer") & B.history_filter(filter_name))
    if filter_name == "sent" and sent_day:
        x = x.filter(B.sent_on(sent_day, F.date_format("sent_at", "yyyy-MM-dd HH:mm:ss")))
    return x


def first_page(rows: DataFrame, sort: str | None, page_size: int = PAGE_SIZE, parity: bool = False) -> DataFrame:
    """D2 + E6 + F2: the first page with ``pos``, ``total`` and ``pages``, in one plan:
    the total is a scalar subquery, the page a distributed top-N (each task sends
    ``page_size`` rows at most)."""
    order = sort_columns(sort, parity)
    total = rows.select(F.count("*")).scalar()
    head = rows.orderBy(*order).limit(page_size)
    x = head.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint")).withColumn("total", total)
    return x.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint"))


class Pages:
    """D2 + E6 + F2: all rows of one view in order, cut into ranges of the order.

    The rows are dealt by ranges of the sort columns, numbered inside their range
    and written once, a folder per range; prefix sums of the ranges' counts (one
    row per range) say which positions a range holds. Any page then reads the
    ranges that it overlaps and nothing else, however deep it lies. The sort
    columns end with the URL, so a common score or day does not make a range
    long; a URL repeated under one key stays in one range.
    """

    def __init__(self, rows: DataFrame, sort: str | None, page_size: int = PAGE_SIZE, parity: bool = False):
        self.page_size = page_size
        order = sort_columns(sort, parity)
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        # the id's low 33 bits count the rows of a partition in the order just made
        numbered = dealt.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        path = table_dir(rows.sparkSession, f"pages-{uuid.uuid4().hex[:12]}")
        numbered.withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
        schema = StructType([*numbered.schema.fields, StructField("_range", IntegerType())])
        self.rows = rows.sparkSession.read.schema(schema).parquet(path)
        counts = self.rows.groupBy("_range").agg(F.count("*").alias("n"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        self.ranges = materialize(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "page-ranges")
        self.total = self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.pages = max(1, -(-self.total // page_size))

    def page(self, number: int) -> DataFrame:
        """The rows of a page with ``pos``, ``total``, ``pages`` and ``page``; a page
        before the first is the first, one past the end the last."""
        number = min(max(number, 1), self.pages)
        low, high = (number - 1) * self.page_size, number * self.page_size
        # no more ranges than the page has rows: ranges without rows are not written
        wanted = self.ranges.where((F.col("start") < high) & (F.col("start") + F.col("n") > low)).collect()
        if not wanted:
            cut = self.rows.withColumn("pos", F.lit(None).cast("bigint")).limit(0)
        else:
            start = F.create_map(*[F.lit(v) for r in wanted for v in (r["_range"], r.start)])
            cut = self.rows.where(F.col("_range").isin([r["_range"] for r in wanted])).withColumn("pos", start[F.col("_range")] + F.col("_place") + 1)
            cut = cut.where((F.col("pos") > low) & (F.col("pos") <= high))
        return cut.drop("_range", "_place").withColumns({
            "total": F.lit(self.total).cast("bigint"), "pages": F.lit(self.pages).cast("bigint"), "page": F.lit(number).cast("bigint")})


def sent_days(ledger: DataFrame) -> DataFrame:
    """D3: distinct UTC days with sends (newest first when ordered by ``day``)."""
    return ledger.select("profile_id", F.to_date("sent_at").cast("string").alias("day")).distinct()


def last_ingest(jobs: DataFrame) -> DataFrame:
    """Latest discovery time per profile."""
    return jobs.groupBy("profile_id").agg(F.max("discovered_at").alias("last_ingest"))


def retain_sent(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """C4 + D13 (G5): keep only listings that were sent, delete the rest.

    Returns every listing tagged ``kept`` (a left join on (profile, url); no
    IN-list, so no size limit): the new table is ``filter(kept)``, and the
    deleted count per profile is ``count_if(not kept)``.
    """
    sent = ledger.select("profile_id", "job_url").distinct().withColumn("_sent", F.lit(True))
    return jobs.join(sent, ["profile_id", "job_url"], "left").withColumn(
        "kept", F.coalesce(F.col("_sent"), F.lit(False))).drop("_sent")
