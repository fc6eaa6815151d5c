"""Exact top-k inner products by vector-approximation files.

Vectors are dealt evenly to slots, each a VA-file of its own: every dimension is
cut into cells of about equally many vectors and a vector is kept as its cell
numbers beside the exact components. A query scans the cells, whose edges bound
its score from both sides, keeps what can still reach the k-th greatest lower
bound, then reads exact vectors in the order of their upper bounds until the
k-th exact score beats the next bound. Candidates move once; the stated query
set is sent to every slot in rows, and a slot answers with k rows a query, which
one window per query merges. Copies of a vector are one entry of the file, so a
vector that a third of the rows share is scanned and read once a slot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch

SLOT_ROWS = 1 << 16  # most candidates of a slot, about 150 MB of work space at 64 dimensions
SCAN = 1 << 13  # cells of so many vectors, for so many queries, are bounded at a time
QUERIES = 1 << 7


def limit_of(dim: int) -> int:
    """The greatest component for which every score of ``dim`` components fits a long."""
    return math.isqrt(2**62 // max(dim, 1))


def integer_components(values: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * x) in doubles, held to what keeps a score within a long."""
    bound = float(limit_of(values.shape[-1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(factor * values), -bound, bound).astype(np.int64)


def packed(row: np.ndarray) -> bytes:
    """Two or eight bytes a component, whichever holds them; the first byte says which."""
    narrow = not row.size or -32768 <= row.min() and row.max() < 32768
    return b"\2" + row.astype("<i2").tobytes() if narrow else b"\10" + row.astype("<i8").tobytes()


def unpacked(rows: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (places in ``rows``, int64 matrix)."""
    by_kind: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(rows):
        by_kind.setdefault((r[0], len(r)), []).append(i)
    parts: dict[int, list] = {}
    for (width, size), at in by_kind.items():
        dim = (size - 1) // width
        joined = b"".join(rows[i][1:] for i in at)
        parts.setdefault(dim, []).append((np.array(at), np.frombuffer(joined, f"<i{width}").astype(np.int64)
                                          .reshape(len(at), dim)))
    return {dim: (np.concatenate([a for a, _ in some]), np.concatenate([m for _, m in some]))
            for dim, some in parts.items()}


class VAFile:
    """The distinct vectors of a slot in cells, and their row ids (ascending, nulls last)."""

    def __init__(self, vectors: np.ndarray, ids: list, bits: int):
        n, dim = vectors.shape
        whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, max(8 * dim, 1)))).ravel() if dim else np.zeros(n, "i1")
        _, first, self_of = np.unique(whole, return_index=True, return_inverse=True)
        self.exact = vectors[first]
        self.ids: list[list] = [[] for _ in first]
        for k in sorted(range(n), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0)):
            self.ids[self_of[k]].append(ids[k])
        entries = Counter(i for some in self.ids for i in dict.fromkeys(some))
        self.repeated = {i: times for i, times in entries.items() if times > 1}  # ids with several vectors
        cells = 1 << bits
        m = len(first)
        self.cell = np.zeros((m, dim), np.uint8)
        self.low, self.high = np.zeros((2, dim, cells))
        for d in range(dim):
            column = self.exact[:, d]
            ranked = np.sort(column)
            marks = ranked[(np.arange(1, cells) * m) // cells]
            at = np.searchsorted(marks, column, side="right")
            self.cell[:, d] = at
            # the least and greatest component of each cell, from its share of the sorted column
            ends = np.searchsorted(ranked, marks, side="left")
            begin, end = np.concatenate([[0], ends]), np.concatenate([ends, [m]])
            full = begin < end
            self.low[d, full] = ranked[begin[full]]
            self.high[d, full] = ranked[end[full] - 1]

    def bounds(self, block: slice, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of a block of cells (rows) for queries (columns)."""
        cell = self.cell[block]
        d = np.arange(cell.shape[1])
        low, high = self.low[d, cell], self.high[d, cell]
        mid, half = (low + high) / 2 @ queries.T, (high - low) / 2 @ np.abs(queries).T
        # doubles are exact for usual components; the slack covers rounding of huge ones
        most = np.maximum(np.abs(low), np.abs(high)) @ np.abs(queries).T
        slack = np.where(most < 2.0**50, 0.0, most * 2.0**-40)
        return mid - half - slack, mid + half + slack

    def search(self, queries: np.ndarray, own: list, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query its k best (score, id) here, ties to the smaller id."""
        for begin in range(0, len(queries), QUERIES):
            part = queries[begin:begin + QUERIES]
            need = k + max(self.repeated.get(i, 1) for i in own[begin:begin + QUERIES])
            for i, (places, upper) in enumerate(self._scan(part.astype(np.float64), need)):
                yield begin + i, self._read(part[i], own[begin + i], places, upper, k)

    def _scan(self, queries: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query the vectors whose upper bound reaches the ``need``-th greatest
        lower bound, best first. ``need`` is k and as many as can be the query's own."""
        nq = len(queries)
        best = np.full((need, nq), -np.inf)
        rows, columns, uppers = [], [], []
        for begin in range(0, len(self.exact), SCAN):
            lower, upper = self.bounds(slice(begin, begin + SCAN), queries)
            best = np.partition(np.concatenate([best, lower]), -need, axis=0)[-need:]
            r, c = np.nonzero(upper >= best.min(axis=0))
            rows.append(r + begin)
            columns.append(c)
            uppers.append(upper[r, c])
        r, c, u = np.concatenate(rows), np.concatenate(columns), np.concatenate(uppers)
        still = u >= best.min(axis=0)[c]
        r, c, u = r[still], c[still], u[still]
        order = np.lexsort((-u, c))
        r, c, u = r[order], c[order], u[order]
        ends = np.searchsorted(c, np.arange(nq + 1))
        for q in range(nq):
            yield r[ends[q]:ends[q + 1]], u[ends[q]:ends[q + 1]]

    def _read(self, query: np.ndarray, own, places: np.ndarray, upper: np.ndarray, k: int) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        at, step = 0, 4 * k
        while at < len(places) and (len(found) < k or upper[at] >= found[k - 1][0]):
            some = places[at:at + step]
            scores = self.exact[some] @ query
            for j in np.flatnonzero(scores >= found[k - 1][0]) if len(found) >= k else range(len(some)):
                score, taken = int(scores[j]), 0
                for row in self.ids[some[j]]:
                    if row is None or row != own:
                        found.append((score, row))
                        taken += 1
                        if taken == k:
                            break
            found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            del found[k:]
            at, step = at + step, 2 * step
        return found


def _encoded(vectors: DataFrame, vector: str, factor: float) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, value in enumerate(batch.column(1)):
                if not value.is_valid or value.values.null_count:
                    continue
                row = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(row).all():
                    keep.append(i)
                    out.append(packed(integer_components(row, factor)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())),
                                              pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(encode, "vec_id bigint, v binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 256, bits: int = 6,
          vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row with ``is_query`` (on
    ``vec_id``) the k other rows of the greatest integer inner products, all of
    them if there are fewer, ties to the smaller vec_id.

    Components are floor(factor * x). Vectors that are null or hold null or
    non-finite components take no part; vectors of other lengths than the query's
    are no candidates of it, those of no components score 0. Components so large
    that a score might not fit a long are held to the greatest that fits. A
    query's own rows are those of its vec_id; repeated rows are candidates each,
    and a query that comes repeatedly with an equal vector is answered once. Rows
    without an id are candidates after all others of their score. Other columns
    are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "va")
    rows = _encoded(vectors, vector, factor)
    queries = scratch.save(_encoded(vectors.where(is_query), vector, factor).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    n = vectors.count()
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(math.ceil(n / SLOT_ROWS), min(spread, math.ceil(n / 512)), 1)
    # Dealt by place in the table: the scan gives each row the same place whenever it is repeated.
    dealt = (rows.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int"))
             .withColumn("q", F.lit(None).cast("bigint"))
             .unionByName(queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))))
             .repartition("slot").sortWithinPartitions("slot", F.col("q").isNotNull()))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, held, files = None, [], [], None
        for batch in batches:
            at = batch.column(2).to_numpy()
            q = batch.column(3)
            is_q = q.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(is_q.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if a == b:
                    continue
                some_ids, some = batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()
                if at[a] != slot:
                    slot, ids, held, files = at[a], [], [], None
                if not is_q[a]:
                    ids += some_ids
                    held += some
                    continue
                if files is None:
                    files = {dim: VAFile(m, [ids[i] for i in rows], bits) for dim, (rows, m) in unpacked(held).items()}
                    ids, held = [], []
                out = []
                for dim, (places, m) in unpacked(some).items():
                    if dim in files:
                        for i, best in files[dim].search(m, [some_ids[p] for p in places], k):
                            out += [(q[a + places[i]].as_py(), some_ids[places[i]], row, score) for score, row in best]
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["q", "query_id", "vec_id", "score"])

    best = dealt.select("vec_id", "v", "slot", "q").mapInArrow(
        searched, "q bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
