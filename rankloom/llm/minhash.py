r"""Document fingerprints by one-permutation MinHash, in built-in functions.

Every word shingle is hashed once; the top seven bits of the hash name its bin
and the smallest hash of each bin stays. An empty bin borrows from the first
occupied bin of its own fixed random order of all bins, which spreads the
borrowing evenly (optimal densification). Four low-order bits per bin are
stored as one hex digit; the likeness of two fingerprints corrects the share of
equal digits for those that are equal by chance.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, let

BIN_BITS = 7
BINS = 1 << BIN_BITS
DIGIT_BITS = 4
WORD_GAP = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, words: int) -> Column:
    """Hashes of the ``words``-word shingles of the lower-cased text; fewer words: the whole sequence."""
    found = F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - words)
        rolled = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, rolled).otherwise(F.array(F.xxhash64(h)))

    return let(F.transform(found, lambda w: F.xxhash64(w)), shingles)


def fingerprint(text: Column, words: int = 5) -> Column:
    """128 hex digits. Null text is null; the empty text has a fingerprint like any other."""
    rng = random.Random(1)
    orders = [rng.sample(range(BINS), BINS) for _ in range(BINS)]
    probe = F.from_json(F.lit(json.dumps(orders)), "array<array<int>>")
    shift = 64 - BIN_BITS

    def bin_of(h: Column) -> Column:
        return (F.shiftright(h, shift) + BINS // 2).cast("int")

    def lowest(h: Column) -> Column:  # sorted: the first of each bin is its smallest
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(h, i - 1), shift)))

    def digits(low: Column, bins: Column) -> Column:
        def digit(i: Column) -> Column:
            own = F.array_position(bins, i)
            lent = F.array_position(bins, F.element_at(F.array_intersect(F.get(probe, i), bins), 1))
            at = F.when(own > 0, own).otherwise(lent)
            kept = F.get(low, (at - 1).cast("int"))
            # hashed with the bin, or a borrowed hash would agree by chance in all its bins at once
            return F.xxhash64(kept, i).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("bigint"))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), digit)

    values = let(F.sort_array(shingle_hashes(text, words)), lambda h: let(lowest(h), lambda low: let(
        F.transform(low, bin_of), lambda bins: digits(low, bins))))
    return F.array_join(F.transform(values, lambda v: F.lower(F.hex(v))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1; null if one is null."""
    equal = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")),
                        F.lit(0), lambda n, x: n + x)
    chance = 2.0 ** -DIGIT_BITS
    estimate = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(equal.isNotNull(), F.greatest(F.lit(0.0), estimate))


def _successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, next_id`` in ascending order, the last one followed by the first.
    Ids alone are range-sorted and written with their range; the ends of the
    ranges (one row each) are linked through the smallest ids of the ranges."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    ids = scratch.save(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")),
                                            F.first("head").over(Window.orderBy("part"))).alias("following"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ids.withColumn("next_id", inside).join(heads, "part").select(
        "doc_id", F.coalesce("next_id", "following").alias("next_id"))


def edited(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, next_id, text, edited``: the text whose last quarter (by code
    points, rounded down) is replaced by as many code points from the start of
    the next document, or all it has. Only the borrowed starts move to another
    row; texts move once, keyed by doc_id. Null text is empty; of several rows
    of the next doc_id the smallest start is borrowed; rows without a doc_id
    have no next document and lose the quarter."""
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = every.where("doc_id is not null")  # for both joins alike, so that they share one exchange of the texts
    quarter = F.floor(F.length("text") / 4).cast("int")
    wants = scratch.save(rows.groupBy("doc_id").agg(F.max(quarter).alias("want"))
                         .join(_successors(docs, scratch), "doc_id"), "wants")
    asked = wants.select("next_id", F.col("doc_id").alias("to_id"), "want")
    lent = (rows.join(asked, rows["doc_id"] == asked["next_id"])
            .select("to_id", F.expr("substring(text, 1, want)").alias("lent"))
            .groupBy("to_id").agg(F.min("lent").alias("lent")))
    own = wants.select(F.col("doc_id").alias("of_id"), F.col("next_id").alias("after_id"))
    both = rows.join(lent, rows["doc_id"] == lent["to_id"], "left").join(own, rows["doc_id"] == own["of_id"], "left")
    alone = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("lent"),
                                                 F.col("doc_id").alias("after_id"))
    both = both.select("doc_id", "text", "lent", "after_id").unionByName(alone)
    return both.select("doc_id", F.col("after_id").alias("next_id"), "text", F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter),
        F.substring(F.coalesce("lent", F.lit("")), F.lit(1), quarter)).alias("edited"))


def compare_edits(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edit.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``: the likeness of the fingerprint to the edit's and
    to the next document's (its smallest, if doc_ids repeat; null without a
    doc_id). Repeated rows stay; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    made = scratch.save(edited(docs, scratch).select(
        "doc_id", "next_id", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), words).alias("fingerprint"),
        fingerprint(F.col("edited"), words).alias("edited_fingerprint")), "fingerprints")
    after = made.groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint"))
    after = after.withColumnRenamed("doc_id", "other_id")
    return made.join(after, made["next_id"] == after["other_id"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
