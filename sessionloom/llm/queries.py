"""A query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, chat, dac, decontaminate, html, jaccard, lines, merkle, quality, simhash, suffix, urls, whitening
from sessionloom.llm.common import read, shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The id after each document in token files.
END = 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_ids(read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("host_words"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    dac.write(read(spark, sf_dir, "documents"), folder, TOKENIZER, END)
    return dac.read_back(spark, folder)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the eight leading components; deviations beyond a long are NULL."""
    white = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 85 % of their distinct four-word shingles."""
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that its version of the tree has."""
    proven = merkle.manifest(read(spark, sf_dir, "documents"))
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash, op3_html, op4_quality, op5_chat, op6_url_filter, op7_byte_bpe, op8_token_files, op9_repeated_passages, op10_line_dedup, op11_whitening, op12_jaccard_join, op13_merkle_manifest)}
