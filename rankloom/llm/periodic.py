"""Periodic runs of words, by Baier's grouping.

A document is a sequence of words. Phase one of Baier's suffix sorter puts
suffixes into groups by a common prefix and goes through the groups from the
greatest to the smallest: every suffix of the group at hand hands its prefix on
to the nearest suffix to the left whose group is still smaller, and suffixes
that were given the same prefix equally often leave their old group together
for a new one just above it. When a group's turn comes its prefix is the longest
Lyndon word that starts at its members, so the phase yields the Lyndon array
directly; it is run under an order of the words and under the reverse order.

A run of three or more periods holds, under one of both orders, two adjacent
equal Lyndon roots, and these are neighbours in one group (Bannai et al., "The
runs theorem"). Each such chain of roots is extended to both sides through the
longest common extension and gives its run once. All steps but the extension
are linear in the words; an extension is shorter than the period on each side.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Run = tuple[int, int, int]  # start, length, period


def _chains(buckets: list[list[int]], n: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """Phase one over positions 1..n. ``buckets`` holds the ascending positions of
    each word, greatest word last. Yields (position, times, root length) of the
    chains of two or more adjacent equal Lyndon roots that can be part of a run
    of ``min_length`` words."""
    members = list(buckets)
    width = [1] * len(members)  # of a group's common prefix
    live = list(map(len, members))
    below = list(range(-1, len(members) - 1))  # the next smaller group
    above = list(range(1, len(members) + 1))
    group = [-1] * (n + 2)
    for g, at in enumerate(members):
        for s in at:
            group[s] = g
    left = list(range(-1, n + 1))  # neighbours among the suffixes of groups not yet passed; 0 and n + 1 are ends
    right = list(range(1, n + 3))
    g = len(members) - 1
    above[g] = -1
    while g >= 0:
        size = width[g]
        given: list[list[int]] = []  # [receiver, times, first member]
        last = -1
        for s in members[g]:
            if group[s] != g:
                continue
            p = left[s]
            r = right[s]
            right[p] = r
            left[r] = p
            if p == last:
                given[-1][1] += 1
            else:
                given.append([p, 1, s])
                last = p
        members[g] = ()
        if len(given) > 1 and any(x[1] > 1 for x in given):
            given.sort(key=_times)  # more often first: it ends up higher; equal ones stay ascending
        made: dict[tuple[int, int], int] = {}
        for p, times, s in given:
            if times > 1 and (times + 2) * size - 2 >= min_length:
                yield s, times, size
            if p == 0:
                continue
            old = group[p]
            new = made.get((old, times)) if made else None
            if new is None and live[old] == 1:
                # the last of its group: the prefix grows in place, nothing lies between old place and new
                width[old] += times * size
                continue
            if new is None:
                new = made[old, times] = len(members)
                members.append([p])
                width.append(width[old] + times * size)
                live.append(1)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
            else:
                members[new].append(p)
                live[new] += 1
            group[p] = new
            live[old] -= 1
        g = below[g]


def _times(given: list[int]) -> int:
    return -given[1]


def _common_right(codes: list[int], i: int, j: int) -> int:
    """How many words agree from i and j > i on."""
    n, done, step = len(codes), 0, 8
    while j + done < n:
        k = min(step, n - j - done)
        if codes[i + done:i + done + k] == codes[j + done:j + done + k]:
            done += k
            step *= 2
        elif k == 1:
            break
        else:
            step = k // 2
    return done


def _common_left(codes: list[int], i: int, j: int) -> int:
    """How many words agree before i and before j > i."""
    done = 0
    while done < i and codes[i - 1 - done] == codes[j - 1 - done]:
        done += 1
    return done


def runs_of(words: list, min_length: int = 24, min_periods: int = 3) -> list[Run]:
    """All (start, length, period) by start, then period: maximal stretches with
    smallest period ``period`` and at least ``max(min_length, min_periods *
    period)`` words. ``min_periods`` is 3 or more: two adjacent roots are sure
    only from there on."""
    if min_periods < 3:
        raise ValueError("min_periods must be 3 or more")
    if len(words) < max(min_length, min_periods):
        return []
    number: dict = {}
    codes = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(codes):
        return []  # no word comes twice
    buckets: list[list[int]] = [[] for _ in number]
    for at, c in enumerate(codes, 1):
        buckets[c].append(at)
    found = set()
    for order in (buckets, buckets[::-1]):
        for s, times, period in _chains(order, len(codes), min_length):
            start = s - 1
            end = start + times * period
            before = _common_left(codes, start, start + period)
            after = _common_right(codes, end - period, end)
            length = before + end - start + after
            if length >= min_length and length >= min_periods * period:
                found.add((start - before, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[Run]) -> list:
    """The words outside all runs or within the first period of each run that holds them."""
    if not runs:
        return words
    kept, at = [], 0
    for first, end in sorted((s + q, s + n) for s, n, q in runs):
        if first > at:
            kept += words[at:first]
        at = max(at, end)
    return kept + words[at:]


def planted(words: list, doc_id: int | None) -> list:
    """A copy with a repeating tail in every document whose crc32 of the decimal id
    is divisible by 10; others, empty ones and those without an id as they are."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


_OUT = pa.struct([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                  ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _measures(words: list, min_length: int, min_periods: int) -> tuple:
    runs = runs_of(words, min_length, min_periods)
    best = None
    for s, n, q in runs:  # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(collapse(words, runs))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, edit=None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_runs``, the run of the greatest
    length/period (``start``, ``length``, ``period``, ``exponent_milli``; nulls
    without a run; ties: smallest start, then period), ``runs_sha256`` and
    ``collapsed_sha256``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared byte by byte.
    ``edit(words, doc_id)`` may change them first. Null and empty texts have no
    words, so no runs and digests of the empty text; repeated rows and rows
    without an id give a row each; other columns are not read. Documents are
    independent, so nothing moves between tasks; a task holds one text at a time.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or b"").split()
                if edit is not None:
                    words = edit(words, at.as_py())
                rows.append(_measures(words, min_length, min_periods))
            columns = list(zip(*rows)) if rows else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, _OUT))],
                ["doc_id", *(f.name for f in _OUT)])

    return docs.selectExpr("doc_id", "cast(text as binary) as text").mapInArrow(
        measured, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, "
                  "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
