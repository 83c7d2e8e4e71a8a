"""The operators over their whole tables, as the driver asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm.align import align_documents
from trendloom.llm.bpe import encoding_digests
from trendloom.llm.common import table
from trendloom.llm.decontaminate import contamination
from trendloom.llm.html import extract_pages
from trendloom.llm.language import identify, learn
from trendloom.llm.quality import learn_quality, score_quality
from trendloom.llm.search import rank_documents
from trendloom.llm.simhash import near_duplicates
from trendloom.llm.substring import repeated_words
from trendloom.llm.tokenfile import token_digests
from trendloom.llm.urls import judge_urls
from trendloom.llm.vectors import near_vectors
from trendloom.llm.warc import read_archives, write_archives


#: Host, path and verdict of the listed urls.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs, but_held_out=True))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    return judge_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS r(host, path, verdict)"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).drop("starts", "lengths")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels"), but_held_out=True))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_simhash_near_dedup, op3_url_filter, op4_substring_dedup, op5_warc, op6_bpe,
    op7_html_extraction, op8_token_files, op9_embedding_near_dedup, op10_benchmark_decontamination,
    op11_quality_classifier, op12_cross_tokenizer, op13_ranked_search)}
