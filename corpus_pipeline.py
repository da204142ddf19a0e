"""From documents to tokens: the stages in order, each a call of one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import bpe, decontaminate, lines, quality, simhash
from sessionloom.llm.common import read, shared_folder, with_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, equal or nearly so, go out of the texts; no document goes."""
    return with_texts(docs, lambda own: lines.dedup_lines(own).select("doc_id", "text"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest doc_id and text."""
    return simhash.first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark phrases are cut out of the texts; no document goes."""
    return with_texts(docs, lambda own: decontaminate.without_benchmark(own, read(spark, sf_dir, "benchmark")))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, as counts and digests, read back from the decoded bytes too."""
    return bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: Cutoffs are certified and tokens made by libraries, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that the stages leave.

    What a stage leaves is written to the shared folder, so that the next one, which reads it
    several times, and a lost executor need no earlier stage again.
    """
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        left = stage(spark, docs, sf_dir)
        folder = shared_folder(spark, f"stage-{n + 1}")
        left.write.parquet(folder)
        docs = spark.read.schema(left.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
