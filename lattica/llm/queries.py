"""One query for each operator: ``opN_<name>`` over its whole table, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, impact_index, itq, langid, line_dedup, merkle, mixing, quality, simhash, substring_index, suffix_tree, toxicity
from .common import documents, remainder


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(simhash.fingerprinted(documents(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", "kept_sha256")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.without_repeats(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = langid.predicted(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    out = led.withColumn("base_failed", ~quality.verdict("base")).withColumn("kept", quality.verdict("v1")).withColumn("kept_without", quality.kept_without("v1"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "kept_without")


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(suffix_tree.marked(documents(spark, sf_dir)))


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer_json: str | None = None) -> DataFrame:
    if tokenizer_json is None:
        import public_tokenizers

        tokenizer_json = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encoded(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_json, keep_ids=False)


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(rows.unionByName(own)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(mixing.sized(documents(spark, sf_dir)))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    found = F.when(remainder(F.col("doc_id"), 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select("doc_id", "source", merkle.digest(*values, F.col("text")).alias("leaf"), merkle.digest(*values, found).alias("claim"))
    return merkle.manifest(rows).drop("source")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return impact_index.ranked(documents(spark, sf_dir).select("doc_id", "text"), items)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
