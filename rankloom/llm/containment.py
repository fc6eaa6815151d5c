r"""Containment search: short test items inside long documents.

Items are put into size classes by their number of distinct word shingles. An
item's signature is its smallest shingle hashes (bottom-k MinHash); for a class
of up to u shingles and a threshold t, k = u - ceil(t * u) + 1 for the largest
size: a document that contains a share t of the item holds at least one of
them, so the search loses nothing, however long the document is. Documents meet
the items through a bit table of about 16 bits per distinct shingle: the
shingles that it lets through are all that leaves a text. Candidates share a
signature hash; exact containment of the shingles, as 64-bit hashes, decides.

All steps are built-in functions; documents are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, let, literal_array

GAP = r"[^\p{L}\p{N}]+"
BITS_PER_SHINGLE = 16  # two of them set: one foreign shingle in 70 passes at most
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24  # 2 MB: beyond a million shingles more foreign ones pass, none is lost
SALTS = 16


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _rolled(h: Column, k: int) -> Column:
    """Hashes of the k-word shingles from word hashes; none for fewer words."""
    starts = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))


def table_bits(n_shingles: int) -> int:
    """The size of the table: a power of two of at least BITS_PER_SHINGLE for each."""
    return min(max(1 << (BITS_PER_SHINGLE * max(n_shingles, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _places(h: Column, bits: int) -> list[Column]:
    """Two bit positions of a hash."""
    return [F.shiftright(h, 7).bitwiseAND(F.lit(bits - 1)), F.shiftright(h, 33).bitwiseAND(F.lit(bits - 1))]


def bit_table(hashes: DataFrame, bits: int) -> Column:
    """A constant array of bits / 64 numbers with the bits of ``h`` set."""
    rows = (hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("cell"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).collect())  # bits / 64 at most
    cells = [0] * (bits // 64)
    for r in rows:
        cells[r.cell] = r.bits
    return literal_array(cells)


def listed(cells: Column, h: Column, bits: int) -> Column:
    """Whether the table has both bits of ``h``: always if ``h`` is in it."""
    hit = None
    for bit in _places(h, bits):
        cell = F.get(cells, F.shiftright(bit, 6).cast("int"))
        one = F.expr("1L").bitwiseAND(_shift_down(cell, bit.bitwiseAND(F.lit(63)).cast("int"))) == 1
        hit = one if hit is None else hit & one
    return hit


def _shift_down(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """``item_id, k, h`` for each distinct shingle of an item: k = ``words``, or all
    words of a shorter item. Items without a word or an id have none."""
    found = items.where("item_id is not null").select("item_id", word_array(F.col("text")).alias("w"))
    k = F.least(F.size("w"), F.lit(words))
    per_size = F.when(F.size("w") == 0, F.expr("cast(array() as array<bigint>)"))
    for n in range(1, words):
        per_size = per_size.when(F.size("w") == n, F.array(F.xxhash64(*[F.xxhash64(F.get("w", F.lit(j))) for j in range(n)])))
    rolled = per_size.otherwise(let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: _rolled(h, words)))
    return found.select("item_id", k.alias("k"), F.explode(F.array_distinct(rolled)).alias("h")).distinct()


def signatures(shingles: DataFrame, threshold: float) -> DataFrame:
    """``item_id, n, h``: n distinct shingles, and the h of the bottom-k signature.
    Classes are powers of two of n; k is that of the class's largest size."""
    sized = shingles.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))  # one item's shingles
    n = F.size("hs")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    k = (upper - F.ceil(upper * threshold - 1e-9) + 1).cast("int")
    return sized.select("item_id", n.alias("n"), F.explode(F.slice("hs", F.lit(1), F.least(k, n))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` for every document
    that holds at least ``threshold`` of an item's distinct shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text. Words are
    lower-cased runs of letters and digits; an item of fewer than ``words``
    words is one shingle. Null, empty and wordless texts and items contain and
    match nothing; rows without an id are passed over; repeated rows count
    once, and the texts of one id count together. Long texts are searched
    whole. Other columns are left out; either table may be empty.
    """
    scratch = Scratch(docs.sparkSession, "containment")
    shingles = scratch.save(item_shingles(items, words), "items")
    signed = scratch.save(signatures(shingles, threshold), "signatures")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1..words
    bits = table_bits(shingles.select(F.count_distinct("h")).first()[0])
    cells = bit_table(shingles, bits)

    def held_in(text: Column) -> Column:
        return let(F.transform(word_array(text), lambda w: F.xxhash64(w)), lambda h: F.array_distinct(
            F.concat(F.expr("cast(array() as array<bigint>)"),
                     *[F.filter(_rolled(h, k), lambda x: listed(cells, x, bits)) for k in lengths])))

    held = scratch.save(docs.where("doc_id is not null and text is not null")
                        .select("doc_id", F.explode(held_in(F.col("text"))).alias("h")), "held")
    # a shingle that a third of all documents hold is dealt over SALTS keys
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hits = held.join(signed.select("*", salts), ["h", "salt"]).select("doc_id", "item_id", "n").distinct()
    shared = (held.join(shingles.select("item_id", "h", salts), ["h", "salt"]).select("doc_id", "item_id", "h")
              .join(hits, ["doc_id", "item_id"]))
    counted = shared.groupBy("doc_id", "item_id").agg(F.first("n").cast("bigint").alias("n_shingles"),
                                                      F.count_distinct("h").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return counted.withColumn("containment", share).where(F.col("containment") >= threshold - 1e-9)


def drop_contaminated(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain an item; columns are unchanged,
    rows without a doc_id stay."""
    found = contained(docs, items, words, threshold).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["found_id"], "left_anti")
