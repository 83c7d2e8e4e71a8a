"""Documents to token ids: language, near-duplicates, repeated passages, test passages, encoding.

Each stage works on all rows that the one before has kept. All but the last
give the columns of `documents`; the last gives doc_id, n_tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm.bpe import token_ids
from trendloom.llm.common import cut_lineage, table
from trendloom.llm.decontaminate import remove_passages
from trendloom.llm.language import keep_identified, learn
from trendloom.llm.queries import tokenizer
from trendloom.llm.simhash import RADIUS, SHINGLE, keep_one_of_each
from trendloom.llm.substring import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart from all others stay."""
    return keep_identified(docs, learn(docs, but_held_out=True))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose fingerprints of three-word shingles differ by three bits at most."""
    return keep_one_of_each(docs, SHINGLE, RADIUS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has, or an earlier place, are cut out."""
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out."""
    return remove_passages(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return token_ids(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding),
]

#: Compression, fingerprints and encoding are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
