"""Concatenate-and-cut packing of tokenized documents.

Pass one tokenizes every text once and writes its ids with the running offset
inside its partition; the partition totals (one row per partition) are summed
to global offsets and joined to the rows of their partition. Pass two reads the table back and cuts every document at the
multiples of the sequence length: no shuffle, no ordering, every task knows
where its tokens stand in the one long stream. A document that crosses a
boundary gives one record per sequence it touches.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, slices, worker_cache

LETTER, NUMBER, OTHER, UNSURE, SPACE, BLANK = range(6)  # white space last
CACHE_PIECES = 400_000
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    """The class of each code point in the vocabulary's split pattern. Code
    points that this Python does not know are UNSURE, and so is the apostrophe,
    which may begin a contraction: texts with them go through the tokenizer whole."""
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER
        elif kind[0] == "N":
            table[c] = NUMBER
        elif kind in ("Cn", "Cs"):
            table[c] = UNSURE
    table[list(WHITE)] = BLANK
    table[32] = SPACE
    table[ord("'")] = UNSURE
    return table


class Tokenizer:
    """Ids of a byte-level BPE ``tokenizers`` file for many texts at once.

    Texts are cut into the pieces of the split pattern by array operations over
    code points, equal pieces of a batch are encoded once, and pieces stay in a
    bounded cache. Ids equal those of ``tokenizers`` with add_special_tokens=False:
    the file's added tokens are single ids wherever they stand in a text. With
    ``encode_special_tokens`` those marked special are ordinary text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        import json
        import re

        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = _byte_letters()
        added = spec.get("added_tokens", ())
        special = {t["content"] for t in added}
        taken = [t for t in added if not (encode_special_tokens and t.get("special"))]
        odd = [t["content"] for t in taken if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if odd:
            raise ValueError(f"added tokens that depend on their surroundings: {odd}")
        self.added = {t["content"]: t["id"] for t in taken}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        ranks = {bytes(shown[ch] for ch in word): rank for word, rank in spec["model"]["vocab"].items()
                 if word not in special}
        # the split pattern of byte-level BPE files of this kind (fixed value)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.whole = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self.known: dict[str, int] = {}  # piece -> its place in begins, sizes
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        held = {i: self.cut.split(t) for i, t in enumerate(texts) if self.cut.search(t)} if self.cut else {}
        if not held:
            return self._ordinary(texts)
        rest = [p for parts in held.values() for p in parts[::2]]
        coded = self._ordinary([*("" if i in held else t for i, t in enumerate(texts)), *rest])
        out, between = coded[:len(texts)], iter(coded[len(texts):])
        for i, parts in held.items():
            out[i] = np.concatenate([np.array([self.added[p]], dtype=np.uint32) if k % 2 else next(between)
                                     for k, p in enumerate(parts)])
        return out

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        out = [np.zeros(0, dtype=np.uint32)] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t.isascii() and "'" not in t:
                plain.append(i)
            elif t:
                kinds = self.classes[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                if (kinds == UNSURE).any():
                    out[i] = np.array(self.whole.encode_ordinary(t), dtype=np.uint32)
                else:
                    plain.append(i)
        plain = [i for i in plain if texts[i]]
        if plain:
            for i, ids in zip(plain, self._pieced([texts[i] for i in plain])):
                out[i] = ids
        return out

    def _pieced(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        c = self.classes[points]
        first = np.zeros(len(c), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        white = c >= SPACE
        gap_before, gap_after = np.zeros_like(first), np.zeros_like(first)
        gap_before[1:] = white[:-1]
        gap_before &= ~first
        gap_after[:-1] = white[1:] | first[1:]
        gap_after[-1] = True  # white space or the end of the text follows
        joins = np.zeros_like(first)  # a blank stands before
        joins[1:] = c[:-1] == SPACE
        same = np.zeros_like(first)
        same[1:] = c[1:] == c[:-1]
        # of white space before other text, the last character stands apart from
        # the run and, if it is a blank, joins the piece that follows
        start = first | (white & ~(gap_before & gap_after)) | ~(white | joins | same)
        at = np.flatnonzero(start)
        if text.isascii():
            bounds = np.append(at, len(c)).astype(np.int32)
        else:
            wide = (points > 0x7F).astype(np.int8)
            wide += points > 0x7FF
            wide += points > 0xFFFF
            extra = np.cumsum(wide, dtype=np.int32)
            bounds = np.append(at + extra[at] - wide[at], len(c) + extra[-1]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.tobytes()),
                                            pa.py_buffer(text.encode())).dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        per = self.sizes[place]
        ends = np.cumsum(per)
        move = self.begins[place]
        move[1:] -= ends[:-1]
        ids = self.pool[np.repeat(move, per) + np.arange(ends[-1])]
        cuts = np.searchsorted(at, np.cumsum(sizes)[:-1])
        return np.split(ids, ends[cuts - 1])

    def _places(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_PIECES:
            self.known, self.pool = {}, self.pool[:0]
            self.begins, self.sizes = self.begins[:0], self.sizes[:0]
        got = list(map(self.known.get, pieces))
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            encode, coded = self.whole._encode_single_piece, []
            for i in new:
                got[i] = self.known[pieces[i]] = len(self.known)
                coded.append(encode(pieces[i]))
            n = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            self.begins = np.append(self.begins, len(self.pool) + np.cumsum(n) - n)
            self.sizes = np.append(self.sizes, n)
            self.pool = np.append(self.pool, np.fromiter((x for ids in coded for x in ids), np.uint32, int(n.sum())))
        return np.array(got, dtype=np.int64)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files:
    printable Latin-1 bytes stand for themselves, the rest for 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer(path: str, encode_special_tokens: bool = False) -> Tokenizer:
    """One per worker process, file and setting."""
    cache, key = worker_cache("tokenizer"), (path, encode_special_tokens)
    if key not in cache:
        cache[key] = Tokenizer(path, encode_special_tokens)
    return cache[key]


def _tokens(docs: DataFrame, path: str, end_id: int, encode_special_tokens: bool) -> DataFrame:
    """``doc_id, ids, n, part, seen``: packed ids with the end id, their number,
    and the tokens before them in the partition ``part``."""
    kind = dict(docs.dtypes)["doc_id"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = tokenizer(path, encode_special_tokens), 0
        for batch in batches:
            texts = batch.column(1).to_pandas().fillna("")
            for a, b in slices(texts, 3_000_000):
                ids = [np.append(x, np.uint32(end_id)) for x in tool.encode(texts.iloc[a:b].tolist())]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array((x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in ids), pa.binary()),
                     pa.array(n), batch.column(2).slice(a, b - a), pa.array(seen + np.cumsum(n) - n)],
                    ["doc_id", "ids", "n", "part", "seen"])
                seen += int(n.sum())

    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(
        encoded, f"doc_id {kind}, ids binary, n bigint, part int, seen bigint")


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0,
         encode_special_tokens: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of ``length`` tokens.

    ``path`` is a byte-level BPE file of ``tokenizers``, readable on the
    executors. ``encode_special_tokens`` is the setting of that name there; its
    default in ``tokenizers`` is False. A document is its ids, then ``end_id``; null and empty texts are
    the end id alone. Documents follow each other in the order they are read.
    Returns per piece ``doc_id, start, length, ids`` (little-endian uint32),
    ``ids_crc32, doc_tokens, sequence_id, offset``. All sequences are full but
    the last. Repeated rows and rows without a doc_id are packed like any other;
    other columns are left out; an empty table gives no piece.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.save(_tokens(docs, path, end_id, encode_special_tokens), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # one row per task of the first pass
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # as many rows as the first pass had tasks, 16 bytes each
    tokens = tokens.join(F.broadcast(base), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("seen")).alias("begin"))
    kind = dict(tokens.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(batch, rows):
            place, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())),
                 *(pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names[1:], rest))], names)

        for batch in batches:
            rows = []
            for place, (packed, n, begin) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                ids = np.frombuffer(packed, dtype="<u2" if len(packed) == 2 * n else "<u4").astype("<u4").tobytes()
                done = 0
                while done < n:
                    here = (begin + done) % length
                    take = min(length - here, n - done)
                    piece = ids[4 * done:4 * (done + take)]
                    rows.append((place, done, take, piece, zlib.crc32(piece), n, (begin + done) // length, here))
                    done += take
                if len(rows) >= 20_000:
                    yield flush(batch, rows)
                    rows = []
            if rows:
                yield flush(batch, rows)

    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return tokens.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, ids_crc32 bigint, "
                                  "doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: the pieces put together in order; ids are
    padded to ``length`` unless n_tokens is a power of two. A group is one
    sequence, ``length`` tokens at most."""
    rows = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("at"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("at", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little")).cast("binary")
    want = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(length) - F.col("n_tokens")).cast("int")
    padded = F.aggregate(F.array_repeat(pad, want), joined, lambda done, x: F.concat(done, x))
    return rows.select("sequence_id", padded.alias("ids"), "n_tokens")
