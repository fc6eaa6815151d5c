r"""Secret spans: fixed patterns plus windowed entropy, all in built-in functions.

Match positions come from the pieces between matches: with the same pattern
``split`` gives the gaps and ``regexp_extract_all`` the matches, so the start of
a match is the length of all gaps and matches before it. Runs of key-like
characters are scored by the Shannon entropy of a sliding window, moved one
character at a time: running counts of its symbols and of their kinds give the
class and the entropy of every window, held against the bar of that class; what
looks like a well-known placeholder is passed over.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import let

# The patterns of the three base kinds; lengths are checked after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more; shorter runs can hold no longer one
HEX = r"[0-9a-f]{16,}"  # likewise
RUN = r"[A-Za-z0-9+/_-]"  # of the candidates of the entropy scan
# Placeholders: documentation words with the key characters next to them, repeated characters, counting runs.
# Only what stands there is passed over; the rest of the run is scanned.
WORDS = "example|sample|placeholder|your|changeme|redacted|dummy"
FILLER = r"x{6,}|(.)\1{7,}|0123456789|abcdefgh|12345678"
UUID = r"(?i)([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})(?![0-9a-z])"
ORDER = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(text: Column, pattern: str, kind: str, long_enough=None) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches that are ``long_enough``."""

    def placed(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"),
                                                         (long_enough(m, i) if long_enough else F.lit(True)).alias("ok")))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

        def step(done: Column, x: Column) -> Column:
            begin = done["at"] + x["gap"]
            span = F.struct(begin.alias("s"), F.lit(ORDER[kind]).alias("k"), (begin + x["n"]).alias("e"))
            return F.struct((begin + x["n"]).alias("at"),
                            F.when(x["ok"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

        return F.aggregate(steps, start, step, lambda done: done["spans"])

    none = F.expr(f"cast(array() as {SPAN})")
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), lambda gaps: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(gaps, found)))).otherwise(none)


# 1-based places in LETTERS
DIGITS, LOWER, UPPER = (1, 10), (11, 36), (37, 62)
HEX_LOWER, HEX_UPPER = (11, 16), (37, 42)
UNIT = 1 << 32  # of the entropy sums, which are whole numbers so that any order of adding gives the same


def _sums(window: int) -> list[int]:
    """c * log2(c) of each count c."""
    return [round(c * log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def entropy_sum(bits: float, window: int) -> int:
    """The greatest sum of c * log2(c) of a window with ``bits`` of entropy or more."""
    return int((log2(window) - bits + 1e-9) * window * UNIT)


def _within(code: Column, places: tuple[int, int]) -> Column:
    return code.between(*places).cast("int")


def reaches_bar(run: Column, window: int, bits: dict, whole: Column) -> Column:
    """Whether one of the windows of ``run`` (``window`` neighbouring characters)
    has the entropy of its class in ``bits``; a shorter run has none.

    One pass: the counts of all symbols and of digits, lower and upper case and
    hex letters go along with the window, one symbol out and one in, and both the
    class and the entropy of every window follow from them. ``whole`` tells of the
    run that ``run`` is a piece of: ``hex`` (one-case hex, judged by that bar
    throughout) and ``mixed`` (holds digits and both cases, so that windows of no
    class are judged too).
    """
    plogp = F.array(*[F.lit(x).cast("bigint") for x in _sums(window)])
    most = {kind: F.lit(entropy_sum(b, window)).cast("bigint") for kind, b in bits.items()}
    kinds = {"d": DIGITS, "l": LOWER, "u": UPPER, "hl": HEX_LOWER, "hu": HEX_UPPER}

    def judged(total: Column, n: dict) -> Column:
        d, low, up = n["d"], n["l"], n["u"]
        one_case = ((n["hl"] > 0) & (d + n["hl"] == window)) | ((n["hu"] > 0) & (d + n["hu"] == window))
        bar = (F.when(whole["hex"], most["hex"]).when((d > 0) & one_case, most["hex"])
               .when((d > 1) & (up > 1) & (d + up == window), most["upper"])
               .when((d > 1) & (low > 1) & (d + low == window), most["lower"])
               .when((low > 3) & (up > 3) & (low + up == window), most["letter"])
               .when(((d > 0) & (low > 0) & (up > 0)) | whole["mixed"], most["mixed"]))
        return F.coalesce(total <= bar, F.lit(False))

    def state(counts: Column, total: Column, n: dict, found: Column) -> Column:
        return let(F.struct(*[c.alias(k) for k, c in n.items()], total.alias("sum")), lambda s: F.struct(
            counts.alias("n"), s.alias("of"),
            (found | judged(s["sum"], {k: s[k] for k in kinds})).alias("found")))

    def scored(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(0), F.lit(len(LETTERS))), lambda j: F.size(F.filter(first, lambda c: c == j)))
        start = let(counts, lambda n: state(
            n, F.aggregate(n, F.lit(0).cast("bigint"), lambda a, c: a + F.get(plogp, c)),
            {k: _count(first, at) for k, at in kinds.items()}, F.lit(False)))

        def moved(s: Column, i: Column) -> Column:
            def step(pair: Column) -> Column:
                out, new = pair["out"], pair["new"]
                c_out, c_in = F.get(s["n"], out), F.get(s["n"], new)
                total = F.when(out == new, s["of"]["sum"]).otherwise(
                    s["of"]["sum"] - F.get(plogp, c_out) + F.get(plogp, c_out - 1) - F.get(plogp, c_in) + F.get(plogp, c_in + 1))
                counts = F.when(out == new, s["n"]).otherwise(
                    F.transform(s["n"], lambda c, j: c - (j == out).cast("int") + (j == new).cast("int")))
                n = {k: s["of"][k] - _within(out, at) + _within(new, at) for k, at in kinds.items()}
                return state(counts, total, n, F.lit(False))

            # what follows a window that reaches its bar need not be read
            return F.when(s["found"], s).otherwise(let(F.struct(
                F.get(codes, i - window).alias("out"), F.get(codes, i).alias("new")), step))

        steps = F.when(F.size(codes) > window, F.sequence(F.lit(window), F.size(codes) - 1)).otherwise(
            F.expr("cast(array() as array<int>)"))
        return F.aggregate(steps, start, moved, lambda s: s["found"])

    # 0 is any other character
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(LETTERS), ch))
    return F.when(F.length(run) >= window, let(codes, scored)).otherwise(False)


def _count(codes: Column, places: tuple[int, int]) -> Column:
    return F.size(F.filter(codes, lambda c: c.between(*places)))


def _suspicious(run: Column, window: int, bits: dict) -> Column:
    """Whether a run has a window that reaches the bar of its class and touches no
    placeholder, nor the ``window`` characters next to a placeholder word. Windows
    are classified one by one, so that prefixes and separators do not matter; ids
    of the form 8-4-4-4-12 count without their hyphens. Words of letters of one
    case are of no class."""
    digit, low, up = run.rlike("[0-9]"), run.rlike("[a-z]"), run.rlike("[A-Z]")
    whole = F.struct((run.rlike("^([0-9a-f]+|[0-9A-F]+)$") & run.rlike("[a-fA-F]") & digit).alias("hex"),
                     (digit & low & up).alias("mixed"))
    allowed = rf"(?i)[a-z0-9]{{0,{window}}}(?:{WORDS})[a-z0-9]{{0,{window}}}|{FILLER}"

    def scored(piece: Column, of: Column) -> Column:
        # a window of any class holds two kinds of characters, unless the whole run decides
        keyed = (piece.rlike("[0-9]") & piece.rlike("[A-Za-z]")) | (piece.rlike("[a-z]") & piece.rlike("[A-Z]"))
        return F.when(keyed | of["hex"] | of["mixed"], reaches_bar(piece, window, bits, of)).otherwise(False)

    return let(whole, lambda of: F.exists(F.split(F.regexp_replace(run, UUID, "$1$2$3$4$5"), allowed, -1),
                                          lambda piece: scored(piece, of)))


def scan(docs: DataFrame, window: int = 20, hex_bits: float = 3.0, mixed_bits: float = 3.8,
         upper_bits: float = 3.4, lower_bits: float = 3.5, letter_bits: float = 3.7) -> DataFrame:
    """``doc_id, base, extra`` for every row of ``docs`` (doc_id, text).

    ``base`` holds the spans (s, k, e) of assignments with a value of 12 or more
    characters, access keys of 18 or more and lower-case hex runs of 16 or more;
    k counts the kinds as in ORDER, s and e are code points, e is exclusive.
    ``extra`` holds runs of ``window`` or more key-like characters with a window that has
    the bits of entropy of its class (one-case hex, upper or lower case with
    digits, letters of both cases, all three), where no base span overlaps. Both
    are sorted by start, then kind. Null and empty texts have none; long texts
    are scanned whole; repeated rows and rows without a doc_id stay; other
    columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("base", F.array_sort(F.concat(
        _spans(F.col("text"), ASSIGN, "assign", lambda m, i: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        _spans(F.col("text"), ACCESS, "access"), _spans(F.col("text"), HEX, "hex"))))
    bits = {"hex": hex_bits, "upper": upper_bits, "lower": lower_bits, "letter": letter_bits, "mixed": mixed_bits}
    extra = _spans(F.col("text"), f"{RUN}{{{window},}}", "entropy", lambda m, i: _suspicious(m, window, bits))
    clear = F.filter(extra, lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return base.select("doc_id", "base", clear.alias("extra"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == ORDER[kind])).cast("bigint")
