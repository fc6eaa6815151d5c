"""A corpus cleaning pipeline: STAGES are applied to ``documents`` in order.

Every stage takes what its predecessor kept, written and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import containment, line_dedup, packing, simhash, toxicity
from rankloom.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Labels of the rows whose
    crc32(doc_id) mod 3 is 1 are not learnt from, as in op1."""
    known = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return toxicity.drop_toxic(docs, known, level=0.7)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; text and n_chars follow."""
    return line_dedup.drop_shared_lines(docs, min_docs=10).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (three words, three bits)."""
    return simhash.keep_one(docs, words=3, distance=3)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024,
                        encode_special_tokens=False)


STAGES = [("toxicity", toxic), ("line dedup", shared_lines), ("SimHash near-dedup", near_copies),
          ("benchmark decontamination", leaked), ("packing", packed)]

ORACLE_SQL = None  # a trained model, XXH64 fingerprints and a tokenizer: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
