"""Corpus pipeline: quality rules, near-dedup, secret scan, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptloom.llm import near_copies, packing, quality_llr, secret_scan, source_mix
from scriptloom.llm.common import cut, read_table
from scriptloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; ties with the
    threshold stay, repeated rows share their fate, an empty table stays empty, all columns stay."""
    return quality_llr.keep_good(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that of the least
    id; null and empty texts are one group, rows without an id come last in the choice, an empty
    table stays empty, all columns stay."""
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, null and empty texts as they are, and
    repeated rows are redacted alike; an empty table stays empty, all columns stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or leave, until each source has its target share; texts without words leave, a
    null source is a source, equal rows share their fate; an empty table stays empty, all columns stay."""
    return source_mix.repeat_to_targets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; null text is empty, rows without an id and repeated rows are packed,
    an empty table gives an empty result."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: SQL has neither the hashes of the fingerprints and n-grams nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)  # later stages read it more than once
    return docs
