"""The training-data pipeline: operators of lattica.llm applied in a row, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, langid, line_dedup, mixing, near_copies
from lattica.llm.common import documents, stored

#: Language ID rejects a document whose language is undetermined or holds less than this share of its own n-grams. Clean texts
#: lie far above it, whatever the number of languages; a text in none of the learned ones lies below.
LEAST_KNOWN = 0.3


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names that clash with no operator's; the identity and the text keep theirs."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; columns unchanged. Null texts and those without a letter have none."""
    plain = _plain(docs)
    out = langid.predicted(plain, langid.fit(docs)).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= LEAST_KNOWN))
    return out.select(*plain.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their later repeated runs of lines and passages; those of which no line is left go. n_chars, if there, follows the text."""
    plain = _plain(docs)
    out = line_dedup.deduplicated(plain)
    out = out.filter((F.col("n_lines") == 0) | (F.col("n_removed_lines") < F.col("n_lines")))
    for i, c in enumerate(docs.columns):
        if c == "n_chars":
            changed = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col(f"c{i}"))
            out = out.withColumn(f"c{i}", changed)
    return out.select(*plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs that SimHash finds and whose five-word Jaccard similarity is 0.8 or more."""
    return near_copies.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_json: str | None = None) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    if tokenizer_json is None:
        import public_tokenizers

        tokenizer_json = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encoded(docs.select("doc_id", "source", "text"), tokenizer_json)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Language ID, near copies and the encoder have no SQL; run() and each stage are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
