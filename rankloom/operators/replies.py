"""Reply handling: match a reply to its proposal (C8, E8), strip quotes (H12),
classify intent (H9-H11, C11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import bound, first_word

# Intent word lists, as in the reference.
APPROVE_WORDS = ["approve", "yes", "ok", "okay", "yep", "yup", "sure", "go", "apply", "accepted", "accept",
                 "agreed", "agree", "confirmed", "confirm", "lgtm", "good", "great", "perfect", "done"]
REJECT_WORDS = ["reject", "no", "nope", "nah", "cancel", "stop", "denied", "deny", "decline", "skip", "abort",
                "discard", "ignore", "nevermind", "never"]
# Our stricter default mode: negations never approve.
NEGATIONS = ["not", "dont", "don't", "no", "nope", "never", "cant", "can't", "won't", "wont"]


def _fuzzy_hit(word: Column, vocab: list[str]) -> Column:
    """Any vocabulary word within edit distance 2 (words up to 5 letters) or 3."""
    arr = F.array(*[F.lit(w) for w in vocab])
    return F.exists(arr, lambda v: F.levenshtein(word, v) <= F.when(F.length(v) <= 5, 2).otherwise(3))


def intent(text, parity: bool = True) -> Column:
    """Exact approve, exact reject, fuzzy approve, fuzzy reject, else
    ``freeform``. The word lists are per-row literals: no join at all.

    ``parity`` keeps the reference's hazards (an empty reply approves: it is
    within 2 edits of ``ok``). The default-safe mode needs a word of at least
    four letters for fuzzy matches and never approves a negation.
    """
    return bound(first_word(text), lambda w: word_intent(w, parity))


def word_intent(w: Column, parity: bool = True) -> Column:
    """H11 of a reply's first word."""
    exact_a, exact_r = w.isin(*APPROVE_WORDS), w.isin(*REJECT_WORDS)
    fuzzy_a, fuzzy_r = _fuzzy_hit(w, APPROVE_WORDS), _fuzzy_hit(w, REJECT_WORDS)
    if not parity:
        long_enough = F.length(w) >= 4
        fuzzy_a = fuzzy_a & long_enough & ~w.isin(*NEGATIONS)
        fuzzy_r = fuzzy_r & long_enough
    return (F.when(exact_a, "approve").when(exact_r, "reject")
            .when(fuzzy_a, "approve").when(fuzzy_r, "reject").otherwise("freeform"))


def match(replies: DataFrame, proposals: DataFrame) -> DataFrame:
    """C8 + E8: unseen replies whose In-Reply-To names the proposal's message id,
    else (only if none) those whose References do; the latest uid wins.

    Two equi joins tagged with a priority, then one grouped ``max_by`` per
    proposal (partial aggregation; no window over the inbox)."""
    unseen = replies.filter(~F.coalesce(F.col("seen"), F.lit(False)))
    p = proposals.select("proposal_id", "message_id").filter(F.coalesce(F.col("message_id"), F.lit("")) != "")
    by_irt = unseen.join(p, unseen.in_reply_to == p.message_id).select("proposal_id", "uid", F.lit(1).alias("prio"))
    refs = unseen.select("uid", F.explode(F.array_distinct("references")).alias("ref"))
    by_ref = refs.join(p, refs.ref == p.message_id).select("proposal_id", "uid", F.lit(2).alias("prio"))
    both = by_irt.unionByName(by_ref)
    best = both.groupBy("proposal_id").agg(F.max_by(F.struct("prio", "uid"),
                                                    F.struct((-F.col("prio")).alias("p"), F.col("uid"))).alias("b"))
    return best.select("proposal_id", F.col("b.uid").alias("uid"),
                       F.when(F.col("b.prio") == 1, "in_reply_to").otherwise("references").alias("matched_by"))


def decode_text(raw, charset) -> Column:
    """Bytes of a landed mail part to text by its declared charset (UTF-8
    when none is declared)."""
    r = F.col(raw) if isinstance(raw, str) else raw
    cs = F.upper(F.coalesce(F.col(charset) if isinstance(charset, str) else charset, F.lit("UTF-8")))
    out = F.decode(r, "UTF-8")  # unknown charsets decode as UTF-8 (with replacement)
    for name, aliases in CHARSETS.items():
        out = F.when(cs.isin(*aliases), F.decode(r, name)).otherwise(out)
    return out


# Charsets the decoder knows, with their common labels.
CHARSETS = {
    "ISO-8859-1": ["ISO-8859-1", "LATIN1", "LATIN-1", "ISO8859-1"],
    "US-ASCII": ["US-ASCII", "ASCII"],
    "UTF-16": ["UTF-16"],
    "UTF-16BE": ["UTF-16BE"],
    "UTF-16LE": ["UTF-16LE"],
}


ENCODED = r"=\?([^?\s]+)\?([bBqQ])\?([^?\s]*)\?="


def decode_header(raw) -> Column:
    """A mail header with encoded words (base64 or quoted, each with a charset
    of its own) as text. White space between two encoded words goes, other text
    stays as it is; what claims to be base64 and is not stays undecoded."""
    r = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    joined = F.regexp_replace(r, rf"({ENCODED})\s+(?=={chr(92)}?[^?\s]+\?[bBqQ]\?[^?\s]*\?=)", "$1")
    # words and the text between them, in turns
    return bound(joined, lambda h: F.when(h.rlike(ENCODED), bound(F.split(h, ENCODED, -1), lambda gaps: F.array_join(F.transform(
        gaps, lambda gap, i: F.concat(gap, F.coalesce(_decoded(F.get(F.regexp_extract_all(h, F.lit(ENCODED), F.lit(0)), i)), F.lit("")))), "")))
        .otherwise(h))


def _decoded(word: Column) -> Column:
    charset, kind, text = (F.regexp_extract(word, ENCODED, k) for k in (1, 2, 3))
    signs = F.regexp_extract_all(F.replace(text, F.lit("_"), F.lit(" ")), F.lit("=[0-9A-Fa-f]{2}|(?s)."), F.lit(0))
    quoted = F.unhex(F.array_join(F.transform(signs, lambda c: F.when(F.length(c) == 3, F.substring(c, 2, 2)).otherwise(F.hex(c))), ""))
    data = F.when(F.lower(kind) == "b", F.call_function("try_to_binary", text, F.lit("base64"))).otherwise(quoted)
    return F.when(word.isNotNull(), F.coalesce(decode_text(data, F.regexp_replace(charset, r"\*.*", "")), word))
