r"""Licence scan by canonical digest lookup, in built-in functions.

A text is brought to a canonical form in which copies of a licence that differ
in case, punctuation, white space, copyright lines or equivalent spellings are
equal; the SHA-256 of the whole form is hash-joined to the digests of known
licences. The same lookup is made for every line taken as a text of its own,
which finds one-line notices inside other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, let
from rankloom.llm.license_texts import KNOWN, all_known  # KNOWN: the values of OP8_SQL

# Equivalent spellings as (pattern, replacement), on lower-case text, in this order.
SPELLINGS = (
    (r"\b(author|capital|categor|emphas|initial|maxim|organ|optim|recogn|real|util)is(e|ed|es|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(fav|lab|hon|behavi)our", "$1or"),
    (r"\b(licen|offen|defen)ce", "$1se"),
    (r"\b(cent|calib)re\b", "$1er"),
    (r"\b(analog|catalog)ue", "$1"),
    (r"\b(cancel|label|model|signal)l(ed|ing)\b", "$1$2"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\b(fulfil|wilful)\b", "$1l"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\b(sub|non)[-\x20](licens|commerc)", "$1$2"),
    (r"\bcopyright owner", "copyright holder"),
    (r"https://", "http://"),
)
# those of two words once more where a line ended between them
OVER_LINES = ((r"\b(sub|non)\x20(licens|commerc)", "$1$2"), (r"\bper\x20cent\b", "percent"), (r"\bcopyright\x20owner", "copyright holder"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUOTES, PLAIN_QUOTES = "‘’“”–— ", "''\"\"-- "
COPYRIGHT_LINE = r"(?m)^[\x20\x09]*(copyright\b|\(c\)|©|all rights reserved).*$"  # of OP8_SQL only: its lines hold no other
# Copyright statements, on lower-case text. Comment marks may stand before them, and a licence's title; they
# end with the line or before the licence's first words, however long they are.
_MARKS = r"[^\p{L}\p{N}\n(©]*+"
_TITLE = r"(?:(?:the\x20)?(?:mit|isc|zlib|bsd[\x20a-z0-9-]{0,20})\x20licen[cs]e(?:\x20\((?:mit|isc)\))?[\x20\x09:.]*)?"
_PART = r"(?:(?:some\x20)?(?:portions|parts)(?:\x20of\x20this\x20(?:software|file|code|work)\x20(?:are|is))?\x20)?"
_YEAR = r"(?:[<\[{]?(?:\d{4}|years?|yyyy)\b)"
_BODY = (r"permission\x20is\x20hereby|permission\x20to\x20use|redistribution\x20and\x20use|this\x20software\x20is\x20provided|"
         r"licen[cs]ed\x20under|released\x20under|everyone\x20is\x20permitted|this\x20(?:program|library|file)\x20is")
STATEMENT = (rf"(?m)^({_MARKS}{_TITLE}){_PART}(?:copyright\b[\x20\x09:,-]*(?:\(c\)|©|&copy;|{_YEAR})|"
             rf"(?:\(c\)|©)[\x20\x09,]*(?:copyright[\x20\x09]*)?{_YEAR}).*?(?:$|(?={_BODY}))")
RESERVED = rf"(?m)^{_MARKS}all\x20rights\x20reserved(?:\W*$|[\x20\x09.]*(?={_BODY}))"
# a holder without a year: lines that are a paragraph of their own
_HOLDER = (rf"{_MARKS}{_PART}(?:(?:copyright|©)[\x20\x09:]+(?!(?:notice|holder|owner|licen[cs]e|laws?|statement|interest|and|or|on|the"
           r"\x20(?:software|program|work|library))\b)[^\n]{2,}+|\(c\)[\x20\x09]+[^\n;:,]{2,}+(?=\n|\z))")
HOLDERS = rf"(?<=\A|\n[^\p{{L}}\p{{N}}\n]{{0,8}}\n){_HOLDER}(?:\n{_HOLDER})*(?=\n[^\p{{L}}\p{{N}}\n]*(?:\n|\z)|\z)"
PUNCTUATION = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"


def without_statements(c: Column) -> Column:
    """Lower-case text without copyright statements; their line ends stay. Where no
    other word would be left, no licence can be either: a text that is more than
    a statement's line (200 characters) then stays as it is, as prose."""
    def dropped(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, STATEMENT, "$1"), RESERVED, ""), HOLDERS, "")
        return let(bare, lambda b: F.when((F.length(c) > 200) & ~b.rlike(r"[\p{L}\p{N}]"), c).otherwise(b))

    marked = (c.contains("copyright") | c.contains("(c)") | c.contains("©") | c.contains("all rights reserved"))
    return F.when(marked, dropped(c)).otherwise(c)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + QUOTES, LOWER + PLAIN_QUOTES)


def canonical_lines(text: Column, statements: bool = False) -> Column:
    """The text in canonical form with its line ends; every line is stripped.
    ``statements``: copyright statements stay."""
    return canonical(lowered(text) if statements else let(lowered(text), without_statements))


def canonical(c: Column) -> Column:
    """The rest of the form, for lower-case text."""
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(c, PUNCTUATION, " ")
    c = F.regexp_replace(c, r"[\x20\x09\x0b-\x0d]+", " ")
    return F.trim(F.regexp_replace(c, r"\x20?\n\x20?", "\n"))


def whole(lines: Column) -> Column:
    """Canonical lines as one text without empty lines and line ends."""
    c = F.trim(F.regexp_replace(lines, r"[\x20\n]+", " "))
    for pattern, to in OVER_LINES:
        c = F.regexp_replace(c, pattern, to)
    return c


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """``license_id, digest`` of (license_id, text) pairs, all known ones if none are
    given, without and with copyright statements; canonically equal texts of two
    ids go by the smaller id."""
    rows = spark.createDataFrame(list(known or all_known()), "license_id string, text string")
    forms = F.array(*[F.sha2(whole(canonical_lines(F.col("text"), kept)), 256) for kept in (False, True)])
    return (rows.select("license_id", F.explode(forms).alias("digest"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``doc_id, canonical_sha256, license_id, notices`` per row of ``docs`` (doc_id, text).

    ``license_id`` is the known licence that the entire text is, null if none; texts
    with statements in the middle (GPL) are also held against it as they are;
    ``notices`` the sorted distinct licences that single lines of it are, comma
    joined, empty if none. Texts without a word have the digest of the empty
    form and match nothing. Repeated rows and rows without a doc_id stay; rows
    of one doc_id share their notices; other columns are left out.

    Texts are brought to canonical form once; what the joins read is a table of
    their digests, 32 bytes for each text and each distinct line.
    """
    scratch = Scratch(docs.sparkSession, "licenses")

    def digest(c: Column) -> Column:
        return F.unhex(F.sha2(c, 256))

    def forms(full: Column, cut: Column) -> Column:
        return let(canonical(cut), lambda c: F.struct(
            digest(whole(c)).alias("text"),
            F.transform(F.filter(F.array_distinct(F.split(c, "\n")), lambda x: x != ""), digest).alias("lines"),
            F.when(full != cut, digest(whole(canonical(full)))).alias("uncut")))  # only where statements went

    own = docs.select("doc_id", let(lowered(F.col("text")), lambda full: let(
        without_statements(full), lambda cut: forms(full, cut))).alias("at"))
    own = scratch.save(own.select("doc_id", "at.text", "at.lines", "at.uncut"), "digests")
    known = digests.select(F.unhex("digest").alias("known"), "license_id")
    found = (own.select("doc_id", F.explode("lines").alias("line")).join(known, F.col("line") == F.col("known"))
             .groupBy(F.col("doc_id").alias("of_id"))
             .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices")))
    empty = F.unhex(F.sha2(F.lit(""), 256))
    named = own.join(known, (own["text"] == known["known"]) & (known["known"] != empty), "left")
    again = digests.select(F.unhex("digest").alias("known_uncut"), F.col("license_id").alias("uncut_id"))
    named = named.join(again, named["uncut"] == again["known_uncut"], "left")
    return named.join(found, named["doc_id"].eqNullSafe(found["of_id"]), "left").select(
        "doc_id", F.lower(F.hex("text")).alias("canonical_sha256"), F.coalesce("license_id", "uncut_id").alias("license_id"),
        F.coalesce("notices", F.lit("")).alias("notices"))
