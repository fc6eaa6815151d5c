"""Which URLs a growing table already holds, without reading that table.

Every batch adds one *run*: its URLs, dealt by the high bits of their hash into
``2^bits`` folders, with as many bits as keep a folder at about ``per_bucket``
URLs. A look-up reads, of each run, only the folders that the hashes of its own
URLs name. ``fan`` neighbouring runs of one tier are merged into one of the next
tier, with the bits that its size asks for; so there are at most ``fan`` runs in
each of log_fan(batches) tiers, a URL is rewritten once per tier, and what a
batch of given size reads depends on its own size and on that logarithm, not on
how much is stored.

URLs are compared as texts; the hash only names the folder.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BITS = 12  # at most 4,096 folders a run; the driver holds that many numbers
URLS = "job_url string"


@dataclass(frozen=True)
class Run:
    """The URLs of the versions ``first`` to ``last``, in ``2^bits`` folders."""

    first: int
    last: int
    bits: int

    @property
    def name(self) -> str:
        return f"run={self.first}-{self.last}-{self.bits}"


def bucket(bits: int, url="job_url") -> Column:
    """The folder of a URL: the ``bits`` high bits of its hash."""
    if bits == 0:
        return F.lit(0)
    return F.shiftrightunsigned(F.xxhash64(url), 64 - bits).cast("int")


class UrlIndex:
    """Versions are batch numbers, 0 and up, added in ascending order. A version
    that is added again (a replayed batch) replaces its own run; look-ups name the
    version they stand before, so a replay sees what the first attempt saw."""

    def __init__(self, spark: SparkSession, path: str, per_bucket: int = 1_000_000, fan: int = 8):
        self.spark, self.path, self.per_bucket, self.fan = spark, path, per_bucket, fan

    # ---- folders

    def _list(self, *below: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *below))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, run: Run) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, run.name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _finished(self) -> list[Run]:
        """Runs that were written to their end: a write that broke off has no _SUCCESS."""
        runs = [Run(*map(int, n[4:].split("-"))) for n in self._list() if n.startswith("run=")]
        return [r for r in runs if "_SUCCESS" in self._list(r.name)]

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that hold the versions below ``before``, none inside another."""
        have = [r for r in self._finished() if before is None or r.last < before]
        return sorted((r for r in have if not any(o.first <= r.first and r.last <= o.last and o != r for o in have)),
                      key=lambda r: r.first)

    def _urls(self, paths: list[str]) -> DataFrame:
        """Folders of several runs: their bucket folders are no common partitioning."""
        return self.spark.read.schema(URLS).option("recursiveFileLookup", "true").parquet(*paths)

    # ---- look-up

    def folders(self, urls: DataFrame, before: int | None = None) -> list[str]:
        """The folders in which a URL of ``urls`` may be stored."""
        runs = self.runs(before)
        if not runs:
            return []
        most = max(r.bits for r in runs)
        hit = {r[0] for r in urls.select(bucket(most)).distinct().collect()}  # at most 2^MAX_BITS numbers
        out = []
        for run in runs:
            wanted = {h >> (most - run.bits) for h in hit}
            there = [n for n in self._list(run.name) if n.startswith("bucket=")]
            found = [n for n in there if int(n[7:]) in wanted]
            whole = [os.path.join(self.path, run.name)] if there and len(found) == len(there) else None
            out += whole or [os.path.join(self.path, run.name, n) for n in found]
        return out

    def known(self, urls: DataFrame, before: int | None = None) -> DataFrame:
        """``job_url`` of what is stored (below version ``before``) in the folders
        of ``urls``, each once: every stored URL of ``urls``, and its neighbours."""
        paths = self.folders(urls, before)
        if not paths:
            return self.spark.createDataFrame([], URLS)
        return self._urls(paths).distinct()

    # ---- change

    def add(self, urls: DataFrame, version: int) -> None:
        """The URLs that this version stores; nulls are left out. Runs below it are
        merged first, so that a replay finds them as they are now."""
        self._merge(version)
        for stale in [r for r in self._finished() if r.first == r.last == version]:
            self._remove(stale)
        self._write(urls.select("job_url").where("job_url is not null").distinct(), version, version)

    def _write(self, urls: DataFrame, first: int, last: int, rows: int | None = None) -> None:
        rows = urls.count() if rows is None else rows
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(rows, 1) / self.per_bucket))))
        run = Run(first, last, bits)
        dealt = urls.withColumn("bucket", bucket(bits)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(self.path, run.name))

    def _merge(self, before: int) -> None:
        """Merge every full tier below ``before``, lowest first; what a merge put
        together is removed by the next one, for frames that were read before."""
        current = self.runs(before)
        for gone in [r for r in self._finished() if r.last < before and r not in current]:
            self._remove(gone)
        tier = lambda r: round(math.log(r.last - r.first + 1, self.fan) - 0.499)
        while True:
            groups: dict[int, list[Run]] = {}
            for r in current:
                groups.setdefault(tier(r), []).append(r)
            full = next((g for _, g in sorted(groups.items()) if len(g) >= self.fan), None)
            if full is None:
                return
            parts = full[:self.fan]
            urls = self._urls([os.path.join(self.path, r.name) for r in parts])
            self._write(urls.distinct(), parts[0].first, parts[-1].last)
            current = self.runs(before)
