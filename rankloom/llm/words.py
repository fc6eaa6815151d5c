"""Word scanning of many texts at once, by array operations over code points."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rankloom.llm.common import worker_cache

GAP, BREAK, WORD = range(3)


def _classes() -> np.ndarray:
    """Letters, marks, digits and underscores are words; ``. ! ?`` and \\n break sentences."""
    cache = worker_cache("word classes")
    if "table" not in cache:
        table = np.full(sys.maxunicode + 1, GAP, dtype=np.uint8)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] in "LMN":
                table[c] = WORD
        table[ord("_")] = WORD
        table[[ord(c) for c in ".!?\n"]] = BREAK
        cache["table"] = table
    return cache["table"]


@dataclass
class Words:
    """The words of some texts, in order: the text each is in, its first and last
    code point (exclusive) there, whether it begins a sentence, and its place
    among the distinct ``forms``."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    opens: np.ndarray
    code: np.ndarray
    forms: list[str]


def scan(texts: list[str]) -> Words:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text = "".join(texts)
    if not text:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(bool), none, [])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[points]
    origin = np.cumsum(sizes) - sizes
    cut = np.zeros(len(kind), dtype=bool)
    cut[0] = True
    cut[1:] = (kind[1:] == WORD) != (kind[:-1] == WORD)
    cut[origin[sizes > 0]] = True
    at = np.flatnonzero(cut)
    width = np.ones(len(points), dtype=np.int32)
    for bound in (0x7F, 0x7FF, 0xFFFF):
        width += points > bound
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    bounds = np.append(offsets[at], offsets[-1]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds.tobytes()),
                                        pa.py_buffer(text.encode("utf-8", "surrogatepass"))).dictionary_encode()
    ends = np.append(at[1:], len(kind))
    is_word = kind[at] == WORD
    row = np.searchsorted(origin, at[is_word], side="right") - 1  # the last of equal origins: empty texts hold none
    broken = np.cumsum(kind == BREAK)
    mark = broken[at[is_word]]
    opens = np.ones(len(row), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    codes = coded.indices.to_numpy()[is_word]
    return Words(row, at[is_word] - origin[row], ends[is_word] - origin[row], opens, codes,
                 coded.dictionary.to_pylist())
