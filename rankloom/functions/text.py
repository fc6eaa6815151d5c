"""Scalar text helpers (H-series) as built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-cased runs of letters (anything that is not a letter separates tokens)."""
    # one regex pass: split on runs of non-letters, drop the empty edge pieces
    return F.array_remove(F.split(F.lower(_c(text)), r"[^\p{L}]+"), "")


def clamp(x, lo, hi) -> Column:
    """H3."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def strip_code_fence(raw) -> Column:
    """H6: keep the second piece around a ``` fence, drop a leading ``json``,
    trim all whitespace (Spark ``trim`` strips spaces only)."""
    r = _c(raw)
    inner = F.when(F.contains(r, F.lit("```")), F.coalesce(F.element_at(F.split(r, "```"), 2), F.lit(""))).otherwise(r)
    inner = F.when(F.contains(r, F.lit("```")), F.regexp_replace(inner, r"^json", "")).otherwise(inner)
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def truncate_int(text_or_num) -> Column:
    """H5: Python ``int()`` of a number or numeric text: parse, then truncate toward zero."""
    d = F.trim(_c(text_or_num).cast("string")).try_cast("double")
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("bigint")


# All white space of Unicode (no-break and wide spaces too), and all line ends.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip_space(text) -> Column:
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def first_word(text) -> Column:
    """H9: first whitespace-separated word, lower-case, punctuation ``.,!?;:'"`` stripped at both ends."""
    w = F.lower(F.regexp_extract(_c(text), f"^{SPACE}*([^{SPACE[1:]}+)", 1))  # looks no further than the word
    return F.coalesce(F.regexp_replace(w, r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", ""), F.lit(""))


def strip_quoted(text) -> Column:
    """Drop lines starting with ``>``, join with newline, trim whitespace."""
    lines = F.split(_c(text), LINE_END)
    kept = F.filter(lines, lambda x: ~F.startswith(x, F.lit(">")))
    return strip_space(F.array_join(kept, "\n"))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a lambda variable is,
    an expression inside a lambda is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def list_text(arr, field: str | None = None) -> Column:
    """Comma-joined items, ``none`` when empty."""
    a = _c(arr)
    if field:
        a = F.transform(a, lambda s: s[field])
    return F.coalesce(F.nullif(F.array_join(a, ", "), F.lit("")), F.lit("none"))
