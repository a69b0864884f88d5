"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmark.functions.text import let
from lensmark.llm import exact_dedup, kneser_ney, language, licences, near_dedup, neighbours, packing, periodic, prefix_trie, quality, span_dedup, tokens, toxicity
from lensmark.llm.common import Scratch, in_fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without repeated spans, and how many sentences each had and lost."""
    return span_dedup.drop_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "text")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def _repeating(text: Column, h: Column) -> Column:
    """Where h % 10 is 0, each word i from a = g % n on becomes word a + (i - a) % p; g = h // 10, p = 1 + (n - a) // (3 + g % 8)."""
    g = F.floor(h / 10)

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        of = lambda ap: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < ap["a"], i).otherwise(ap["a"] + F.pmod(i - ap["a"], ap["p"])).cast("int")))
        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), of), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(periodic.WORD), F.lit(0)), made)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _repeating(F.col("text"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))
    found = periodic.periodic_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("highest")
    return found.select(
        "doc_id", "n_runs", top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is null are in no fold that is held out. Sums of logarithms are rounded to six digits, as their last ones depend on the order of adding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(in_fold(F.col("doc_id"), 7, 2), F.lit(False)).alias("held_out"), "text")
    model = kneser_ney.train(docs.filter("NOT held_out").select("text"))
    return kneser_ney.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations start with the first turns of the one whose id is the next lower multiple of five."""
    scratch = Scratch(spark)
    own = scratch.save(prefix_trie.sequences(table(spark, sf_dir, "conversations"), scratch), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = own.select(F.col("conv_id").alias("of"), F.slice("path", 1, 8).alias("head"))
    both = own.withColumn("of", F.col("conv_id") - F.pmod("conv_id", F.lit(5))).join(heads, "of", "left")
    path = F.concat(F.slice(F.coalesce("head", F.slice("path", 1, 0)), F.lit(1), h), F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0))))
    return prefix_trie.prefix_trie(both.select("conv_id", path.alias("path")), scratch)


ALL = (
    op1_toxicity,
    op2_best_fit_packing,
    op3_exact_dedup,
    op4_language_id,
    op5_quality,
    op6_license_scan,
    op7_byte_bpe,
    op8_substring_dedup,
    op9_nearest_vectors,
    op10_near_dedup,
    op11_periodic_runs,
    op12_kneser_ney,
    op13_prefix_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
