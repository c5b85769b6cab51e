"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

``STAGES`` lists them; each function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of ``documents``.

All stages count null texts as empty, take null and repeated ids as they are
(rows go by their own text), give no rows for an empty table and keep columns
of any names.  They work on whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagewatch.llm import decontaminate, exact_dedup, packing, quality, queries, simhash_dedup
from stagewatch.llm.common import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.7 or more).

    Null and empty texts get the score of a text without words; repeated rows
    all stay or all go; where the labels teach nothing every row has the
    labels' mean as its score.
    """
    return quality.keep_quality(docs, queries.table(spark, sf_dir, "labels"), threshold=0.7)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    All null, empty and white-space-only texts are one group; of repeated rows
    one stays.
    """
    return exact_dedup.drop_copies(docs)


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near fingerprints.

    Texts without words share the fingerprint zero and so are one group; of
    repeated rows one stays; repeated ids with texts of different groups each stay.
    """
    return simhash_dedup.drop_near_copies(docs, shingle=4, distance=4, seed=42, unique_ids=False)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts and items leak nothing; repeated rows all stay or all go.
    """
    return decontaminate.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"), whole_ids=False, shingle=5,
                                    threshold=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 4096 tokens.

    A null or empty text is a piece of its end id; repeated ids and rows are
    pieces of their own.
    """
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality classifier", keep_good), ("exact dedup", keep_distinct), ("SimHash near-dedup", keep_different),
          ("benchmark decontamination", keep_clean), ("packing", pack)]

#: The classifier and the packing cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{number + 1}")
    return docs
