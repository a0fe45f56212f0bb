"""Prepare a training corpus: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
everything the stage before kept.  All but the last return the columns of
documents; the last returns each document of the mix with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import bpe, line_dedup, mixing, quality, simhash_wide
from linkweave.llm.common import DOCUMENT_COLUMNS, table
from linkweave.plans.scratch import Scratch

def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of line runs."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, resemblance 0.8 and more)."""
    return simhash_wide.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (packed), n_tokens and digests of ids and decoded text."""
    return bpe.encode_column(docs, ["doc_id", "lang", "source"], reuse=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("byte-level bpe encoding and decoding", encode),
]

#: Kneser-Ney scores, XXH64 fingerprints and BPE merges are not expressed in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.write(out, f"stage{i}")
    return docs
