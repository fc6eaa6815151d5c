"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are the bitwise majority of the XXH64 values of a text's word
shingles. Equal fingerprints are one node from the start, so copies are never
paired. Distinct fingerprints are linked at ``distance`` or fewer bits:

1. the 64 bits are split into ``parts`` groups so that correlated bits share a
   group (a 64 x 64 correlation matrix, summed over all fingerprints);
2. if x and q differ in at most ``distance`` bits, then for thresholds T_i >= -1
   with sum(T_i) = distance - parts + 1 some group i differs in at most T_i
   bits. Each fingerprint gets its own T by dynamic programming over the cost
   of probes plus estimated candidates. The estimate folds, per group, the
   distance histograms of its 8-bit sub-blocks (at most 256 counts each);
3. each fingerprint probes group i with every key within T_i bits of its own
   (T_i = -1: not at all), the candidates are verified on all 64 bits, and the
   links give components by star contraction.

Two groups are the default: 32-bit keys keep the candidates of one probe near
N / 2^32, so with 10^10 fingerprints a bucket still holds a few. A group whose
key is common to many fingerprints makes the search move its threshold to the
other group for these fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankloom.llm.common import Scratch, literal_array
from rankloom.llm.components import components

SEED = 42
BLOCK = 8  # bits of a sub-block of the candidate estimate


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash: words are runs of other than \\x20 \\x09-\\x0D after A-Z are
    lower-cased; fewer words than a shingle: the whole sequence; none: zero."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=n)
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: n - words + 1].tolist()
        of = xxhash.xxh64_intdigest
        hashes = np.fromiter((of(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1:].tolist())),
                             dtype=np.uint64, count=n - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        some = hashes[at:at + 65536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: fp is the fingerprint as a signed bigint. Null text is empty."""

    @pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        got = np.fromiter((fingerprint(t, words) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(got.view(np.int64))

    return docs.select("doc_id", simhash("text").alias("fp"))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(nodes: DataFrame) -> list[int]:
    """The 64 bits in an order in which correlated bits stand together: from the
    bit with the largest total correlation on, always the one that correlates
    most with the last 16 chosen. The counts are 65 sums per task."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy()).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"i": [i for i in range(64) for _ in range(64)], "j": list(range(64)) * 64,
                            "both": total.ravel(), "n": float(n)})

    rows = (nodes.select("fp").mapInPandas(counted, "i int, j int, both double, n double")
            .groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect())  # 4096 rows
    both, n = np.zeros((64, 64)), 1.0
    for r in rows:
        both[r.i, r.j], n = r.both, max(r.n, 1.0)
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    near = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    order = [int(near.sum(axis=0).argmax())]
    while len(order) < 64:
        pull = near[order[-16:]].sum(axis=0)
        pull[order] = -1
        order.append(int(pull.argmax()))
    return order


def _masks(bits: list[int], most: int) -> tuple[list[int], list[int]]:
    """Signed XOR masks over ``bits`` by weight up to ``most``; how many have weight <= 0, 1, ..."""
    masks, upto = [], []
    for weight in range(most + 1):
        masks += [sum(1 << b for b in c) for c in combinations(bits, weight)]
        upto.append(len(masks))
    return [m - (1 << 64) if m >> 63 else m for m in masks], upto


def _histograms(nodes: DataFrame, order: list[int], most: int) -> tuple[np.ndarray, int]:
    """For each 8-bit sub-block and value, how many fingerprints differ in 0..most of its bits."""
    blocks = [order[at:at + BLOCK] for at in range(0, 64, BLOCK)]

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(blocks), 256), dtype=np.int64)
        for batch in batches:
            for k, v in enumerate(_blocks(batch["fp"].to_numpy(), order).T):
                total[k] += np.bincount(v, minlength=256)
        yield pd.DataFrame({"k": np.repeat(np.arange(len(blocks)), 256), "v": np.tile(np.arange(256), len(blocks)),
                            "n": total.ravel()})

    rows = (nodes.select("fp").mapInPandas(values, "k int, v int, n bigint")
            .groupBy("k", "v").agg(F.sum("n").alias("n")).collect())  # 8 x 256 rows
    count = np.zeros((len(blocks), 256))
    for r in rows:
        count[r.k, r.v] = r.n
    apart = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
    return np.stack([count @ (apart == d) for d in range(most + 1)], axis=2), int(count[0].sum())


def _blocks(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """The 8-bit sub-block values of each fingerprint, in ``order``."""
    return np.packbits(_bits(fps)[:, order], axis=1, bitorder="little")


def allocate(cost: np.ndarray, total: int) -> np.ndarray:
    """Per row the thresholds T (one for each part, -1 at least) of least total
    cost with sum(T) = total. ``cost[row, part, T + 1]``. Dynamic programming
    over the parts and the sum so far; ties go to the smaller T of late parts."""
    rows, parts, levels = cost.shape
    span = total + parts + 1  # sums of (T + 1) from 0 to total + parts
    best = np.full((rows, span), np.inf)
    best[:, 0] = 0
    taken = np.zeros((parts, rows, span), dtype=np.int64)
    for i in range(parts):
        nxt = np.full((rows, span), np.inf)
        for step in range(levels):
            for at in range(span - step):
                c = best[:, at] + cost[:, i, step]
                better = c < nxt[:, at + step]
                nxt[better, at + step] = c[better]
                taken[i, better, at + step] = step
        best = nxt
    out, at = np.zeros((rows, parts), dtype=np.int64), np.full(rows, total + parts)
    for i in reversed(range(parts)):
        out[:, i] = taken[i, np.arange(rows), at] - 1
        at = at - out[:, i] - 1
    return out


def links(nodes: DataFrame, scratch: Scratch, distance: int = 3, parts: int = 2) -> DataFrame:
    """``(a, b)``: node ids of ``nodes`` (node, fp; fp distinct) whose fingerprints
    differ in 1..``distance`` bits, each pair once or more."""
    if not 1 <= parts <= distance + 1 or 64 % (parts * BLOCK):
        raise ValueError("parts must divide 8 and be at most distance + 1")
    order = bit_order(nodes)
    near, n = _histograms(nodes, order, distance)
    width = 64 // parts
    groups = [order[i * width:(i + 1) * width] for i in range(parts)]
    masks = [_masks(g, distance) for g in groups]
    total = distance - parts + 1

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy()
            own = _blocks(fps, order)
            cost = np.zeros((len(fps), parts, distance + 2))
            for i in range(parts):
                dist = np.zeros((len(fps), distance + 1))
                dist[:, 0] = n
                for k in range(i * width // BLOCK, (i + 1) * width // BLOCK):
                    share = near[k][own[:, k]] / max(n, 1)
                    dist = np.stack([sum(dist[:, a] * share[:, d - a] for a in range(d + 1))
                                     for d in range(distance + 1)], axis=1)
                cost[:, i, 1:] = np.cumsum(dist, axis=1) + np.array(masks[i][1])
            for i, t in enumerate(allocate(cost, total).T):
                batch[f"probes_{i}"] = np.array([0, *masks[i][1]], dtype=np.int32)[t + 1]
            yield batch

    kinds = dict(nodes.dtypes)
    planned = nodes.select("node", "fp").mapInPandas(
        plan, f"node {kinds['node']}, fp bigint" + "".join(f", probes_{i} int" for i in range(parts)))
    tags = [sum(1 << b for b in g) for g in groups]
    tags = [t - (1 << 64) if t >> 63 else t for t in tags]

    def key(i):
        return F.col("fp").bitwiseAND(F.lit(tags[i]).cast("bigint"))

    index = nodes.select("node", "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), key(i).alias("key"))
                                                           for i in range(parts)])).alias("at"))
    index = index.select(F.col("at.part").alias("part"), F.col("at.key").alias("key"),
                         F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    probes = [planned.where(f"probes_{i} > 0").select(
        F.lit(i).alias("part"), F.col("node").alias("a"), "fp", key(i).alias("own"),
        F.explode(F.slice(literal_array(masks[i][0]), 1, F.col(f"probes_{i}"))).alias("mask"))
        .select("part", F.col("own").bitwiseXOR(F.col("mask")).alias("key"), "a", "fp") for i in range(parts)]
    probe = probes[0]
    for more in probes[1:]:
        probe = probe.unionByName(more)
    # the larger fingerprint asks for the smaller ones; its own thresholds find them all
    found = probe.join(index, ["part", "key"]).where(
        (F.col("fp") > F.col("fp_b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= distance))
    return scratch.save(found.select("a", "b"), "links")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, parts: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs`` (doc_id, text).

    The fingerprint is 16 hex digits; component_id is the smallest doc_id that
    can be reached over links of ``distance`` or fewer bits, its own included.
    Null text counts as empty: fingerprint zero, linked like any other. Repeated
    rows stay repeated; rows of one doc_id with different texts keep their own
    fingerprints and, where that doc_id is the smallest of both, one component.
    Rows without a doc_id get their fingerprint and the component of the others
    with it, null if there are none. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, words), "fingerprints")
    nodes = scratch.save(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = scratch.save(components(links(nodes, scratch, distance, parts), scratch), "components")
    label = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(label, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the
    smallest doc_id. Columns are unchanged and may be of any type. Of several rows
    with that doc_id the smallest by text, then by the other columns as JSON, stays;
    rows without a doc_id stay."""
    lead = (near_duplicates(docs, words, distance).where("doc_id = component_id")
            .select(F.col("doc_id").alias("lead")).distinct())
    mine = docs.join(lead, docs["doc_id"] == lead["lead"], "left_semi")
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    one = mine.groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in docs.columns if c != "doc_id")),
                                              F.struct("text", others)).alias("row"))
    one = one.select(*("doc_id" if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns))
    return one.unionByName(docs.where("doc_id is null"))
