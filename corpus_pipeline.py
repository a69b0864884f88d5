"""From raw documents to packed sequences.

Each stage works on all that its predecessor kept: documents that score as toxic go; of exact
copies the one with the largest id stays; of each group of near-duplicates one document stays; what repeats in other
documents is cut from the texts (and n_chars follows); what is left is packed. A document whose
text is cut to nothing stays, with an empty text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.llm import exact_dedup, near_dedup, packing, span_dedup, toxicity
from lensmark.llm.common import Scratch, free_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5 stay, each on its own: repeated rows and ids alike. Null and empty texts score the prior and
    stay where it is under 0.5. Texts of any length are scored whole; an empty table gives an empty one; other columns pass through."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) one row of the largest id stays, a null id only where there is no other;
    of rows that repeat id and text any one. Empty tables, long texts and other columns as in drop_toxic()."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the row of the smallest id stays; null and blank texts are in no group and
    stay. Rows of repeated and null ids are documents of their own, in the order of ids, nulls last."""
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; sentences that repeat earlier documents' (by id, nulls last) are cut from their texts, and n_chars, where there is
    such a column, follows. Null texts stay null. Columns named like the operator's own keep what they hold."""
    out = span_dedup.drop_repeated_spans(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(free_name(docs, "n_removed")) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row of docs: repeated rows and ids are packed each, null texts as one end token, long ones in
    pieces of 2048 tokens; an empty table gives no pieces. Other columns are left behind."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_spans),
    ("best-fit packing", pack),
]

#: SQL expresses none of the first, fourth and fifth stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and reread as the next one's."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        scratch.drop(before)
    return docs
