"""How filters interact: what each removes in every order of applying them.

Each document gets a mask of the filters that it fails; masks are counted per
part. A part's counts become a decision diagram with one level per filter: a
node has a pass child and a fail child, equal nodes are shared, and every node
carries the counts of the documents below it. Along the path of passes from the
top, the fail child of the k-th node holds what the k-th filter removes and the
pass child what is kept. Two adjacent levels are swapped locally, and a walk of
adjacent swaps visits every order (Steinhaus, Johnson, Trotter), so the diagram
is built once per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch

UPPER = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point
SIGNS = b"#$%&*|"
SPACE = b" \t\n\r\x0b\x0c"
Counts = tuple[int, ...]


def adjacent_swaps(n: int) -> Iterator[int]:
    """The n! - 1 swaps (of levels i and i + 1) that lead through all orders of n things."""
    at, step = list(range(n)), [-1] * n  # thing -> place, direction
    order = list(range(n))
    while True:
        movable = [t for t in range(n) if 0 <= at[t] + step[t] < n and order[at[t] + step[t]] < t]
        if not movable:
            return
        t = movable[-1]
        i = min(at[t], at[t] + step[t])
        a, b = order[i], order[i + 1]
        order[i], order[i + 1] = b, a
        at[a], at[b] = i + 1, i
        for u in range(t + 1, n):
            step[u] = -step[u]
        yield i


class Diagram:
    """A count-weighted decision diagram of failure masks.

    ``counts`` maps a mask (bit i set: filter i fails) to a tuple of counts. A
    node is ``(level, pass child, fail child)`` in a table of unique nodes, a leaf
    the counts themselves; ``None`` is the empty diagram. ``order[k]`` is the
    filter of level k.
    """

    def __init__(self, counts: dict[int, Counts], n_filters: int, width: int):
        self.zero: Counts = (0,) * width
        self.order = list(range(n_filters))
        self._unique: dict[tuple, tuple] = {}
        self._below: dict[int, tuple[tuple, Counts]] = {}
        self.root = self._build(counts, 0)

    def _build(self, counts: dict[int, Counts], level: int):
        if not counts:
            return None
        if level == len(self.order):
            return next(iter(counts.values()))
        split: tuple[dict, dict] = ({}, {})
        for mask, c in counts.items():
            split[mask >> self.order[level] & 1][mask] = c
        return self._node(level, *(self._build(half, level + 1) for half in split))

    def _node(self, level: int, passed, failed):
        if passed is None and failed is None:
            return None
        key = (level, id(passed) if level + 1 < len(self.order) else passed,
               id(failed) if level + 1 < len(self.order) else failed)
        found = self._unique.get(key)
        if found is None:
            found = self._unique[key] = (level, passed, failed)
            self._below[id(found)] = (found, tuple(map(sum, zip(self.total(passed, level + 1),
                                                                 self.total(failed, level + 1)))))
        return found

    def total(self, node, level: int) -> Counts:
        """The counts of all documents below ``node``, which stands at ``level``."""
        if node is None:
            return self.zero
        return node if level == len(self.order) else self._below[id(node)][1]

    def swap(self, i: int) -> None:
        """Exchange levels i and i + 1. Nodes below keep their identity, those above are linked anew."""
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        done: dict[int, tuple] = {}

        def children(node):
            return (None, None) if node is None else node[1:]

        def rebuilt(node):
            if node is None:
                return None
            if id(node) not in done:
                level, passed, failed = node
                if level < i:
                    made = self._node(level, rebuilt(passed), rebuilt(failed))
                else:
                    (pp, pf), (fp, ff) = children(passed), children(failed)
                    made = self._node(i, self._node(i + 1, pp, fp), self._node(i + 1, pf, ff))
                done[id(node)] = made
            return done[id(node)]

        self.root = rebuilt(self.root)

    def steps(self) -> Iterator[tuple[int, Counts, Counts, Counts]]:
        """For each level of the all-pass path: its filter, the counts that pass, that
        fail, and that fail here and pass every later filter (after passing all before)."""
        node = self.root
        for level, f in enumerate(self.order):
            passed, failed = (None, None) if node is None else node[1:]
            only = failed
            for _ in range(level + 1, len(self.order)):
                only = None if only is None else only[1]
            yield f, self.total(passed, level + 1), self.total(failed, level + 1), only or self.zero
            node = passed


OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_orders(counts: dict[int, Counts], letters: str) -> list[tuple]:
    """``(filter_order, step, *OUT)`` for every order and step. ``counts`` gives per
    mask the documents, those labelled good and those labelled toxic."""
    diagram = Diagram(counts, len(letters), 3)
    failing = [0] * len(letters)
    for mask, c in counts.items():
        for f in range(len(letters)):
            failing[f] += c[0] * (mask >> f & 1)
    seen, shapley = [], [0] * len(letters)

    def note():
        name = "".join(letters[f] for f in diagram.order)
        for k, (f, kept, removed, only) in enumerate(diagram.steps(), 1):
            shapley[f] += removed[0]
            seen.append((name, k, f, kept[0], removed[0], failing[f] - removed[0], only[0], removed[1], removed[2]))

    note()
    for i in adjacent_swaps(len(letters)):
        diagram.swap(i)
        note()
    return [(name, k, *rest, shapley[f]) for name, k, f, *rest in seen]


def audit(masks: DataFrame, letters: str, part: str = "part", mask: str = "mask") -> DataFrame:
    """``part``, ``filter_order``, ``step`` and the counts ``OUT`` for every value of
    ``part``, every order of ``letters`` and every step.

    ``masks`` has one or more rows per part and mask (bit i set: the i-th letter's
    filter fails) with the counts ``n``, ``good`` and ``toxic``. Its rows are summed
    per part and mask before anything moves, so a part's group is at most
    2^len(letters) rows whatever its size. An empty table has no parts.
    """
    summed = masks.groupBy(part, mask).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")))

    def audited(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {m: c for m, *c in rows[[mask, "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(audit_orders({int(m): tuple(map(int, c)) for m, c in counts.items()}, letters),
                           columns=["filter_order", "step", *OUT])
        out.insert(0, part, rows[part].iloc[0])
        return out

    kind = ", ".join(f"{c} bigint" for c in OUT)
    return summed.groupBy(part).applyInPandas(audited, f"{part} string, filter_order string, step int, {kind}")


def _distinct_words(text: bytes, size: int = 1 << 20) -> tuple[int, int]:
    """Words and distinct words, a piece of about ``size`` bytes at a time."""
    if len(text) <= size:
        words = text.split()
        return len(words), len(set(words))
    n, forms, at = 0, set(), 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in SPACE:
            end += 1
        words = text[at:end].split()
        n += len(words)
        forms.update(words)
        at = end
    return n, len(forms)


def failures(text: bytes) -> int:
    """Bits 0 to 3 of A (few words), B (repetitive), C (capitals) and D (signs)."""
    n, distinct = _distinct_words(text)
    capitals = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUATION))
    return ((n < 100) | (100 * distinct < 80 * n) << 1 | (100 * capitals > 10 * points) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def document_masks(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """``part, mask, n, good, toxic`` of the filters A to E over whole texts.

    E (bit 4): the text is identical to that of a smaller doc_id anywhere in the
    table. Null and empty texts are the same text; rows without an id never fail E
    and have no label; rows that repeat an id are all counted, and none is smaller
    than the other. ``good`` and ``toxic`` count rows whose doc_id has such a label
    in any row of ``labels``. Of the texts only a mask and a 16-byte digest move;
    "is the first of its text" is joined on (digest, doc_id), so a text that a
    third of all rows share is dealt over all tasks.
    """
    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(map(failures, texts), pa.int32()),
                 pa.array((hashlib.blake2b(t, digest_size=16).digest() for t in texts), pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    kind = dict(docs.dtypes)["doc_id"]
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.save(
        docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(part, F.lit("")).alias("part"))
        .mapInArrow(masked, f"doc_id {kind}, part string, mask int, digest binary"), "rows")
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    judged = (named.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
              .select("part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"),
                      F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return (judged.unionByName(nameless).groupBy("part", "mask")
            .agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))

