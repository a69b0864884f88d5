"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Grouping keys hold the whole normalised text
beside its digest, so that every stage compares full content: each task first combines its own rows,
salted digest groups merge those partial winners, and the winners of all salts are combined
globally. A group with a third of all rows thus reaches any task as one row for each sender.
Rows find their group again by its digest and a second, independent hash, the largest groups in parts; the combined groups
are checked to hold one text for each such pair, else the query fails rather than merging unlike texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensmark.llm.common import Scratch, free_name, salted_join
from lensmark.llm.near_dedup import BROADCAST_IDS

SALTS = 8
#: Pairs of id and digest that are broadcast: five times an id's bytes each.
BROADCAST_PAIRS = BROADCAST_IDS // 5


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per group of equal texts: digest, check_hash, keep_id (the largest id), group_size."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), normalised(F.col(text_column)).alias("norm"))
    rows = rows.select("id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return winners.select("digest", F.xxhash64("norm").alias("check_hash"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The row with the largest id stays; rows that repeat that id with the
    same text are all marked as kept here. A null id never wins over another; a group of null ids only has a null
    keep_id and its rows are marked as kept. Texts of any length are compared whole. An empty table gives an empty result; other
    columns are ignored.
    """
    groups = exact_groups(docs, id_column, text_column)
    one = groups.groupBy("digest", "check_hash").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    one = one.withColumn("keep_id", F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long")))
    one = Scratch(docs.sparkSession).save(one.drop("texts"), "groups")
    norm = normalised(F.col(text_column))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("check_hash"))
    found = salted_join(rows, one, ["digest", "check_hash"], "group_size", F.xxhash64("id"))
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False))
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: one of those with the largest id.

    Rows are told apart by id and text, so that other texts under a lost row's id stay. Of rows that repeat the
    id and the text any one stays; so of a group of null ids only. Null texts count as empty; texts of any length are compared
    whole; other columns pass through, whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    id_, digest = free_name(docs, "id"), free_name(docs, "digest")
    key = [F.col(id_column).cast("long").alias(id_), F.unhex(F.sha2(normalised(F.col(text_column)), 256)).alias(digest)]
    rows = exact_duplicates(docs, id_column, text_column).select(F.col(id_column).alias("id"), F.unhex("text_sha256").alias("digest"), "kept")
    pairs = rows.groupBy("id", "digest", "kept").agg(F.count("*").alias("n")).filter("NOT kept OR n > 1")
    pairs = scratch.save(pairs.select("id", "digest", "kept"), "copies")

    def met(side: DataFrame, few: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(few) if few.count() <= BROADCAST_PAIRS else few
        return side.join(few, side[id_].eqNullSafe(few["id"]) & (side[digest] == few["digest"]), how)

    keyed = docs.select("*", *key)
    lost, repeated = pairs.filter("NOT kept").drop("kept"), pairs.filter("kept").drop("kept")
    if repeated.isEmpty():
        return met(keyed, lost, "left_anti").select(docs.columns)
    single = met(keyed, pairs.drop("kept"), "left_anti")
    one = met(keyed, repeated, "left_semi").dropDuplicates([id_, digest])
    return single.unionByName(one).select(docs.columns)
