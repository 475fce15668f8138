"""Queries of the operators on training text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.leak import leaked_passages, without_passages
from quantloom.llm.linegraph import boilerplate_blocks, repeated_lines, without_repeated_lines
from quantloom.llm.mixture import mix
from quantloom.llm.template import furniture_lines, main_body
from quantloom.llm.textstats import not_prose, text_statistics
from quantloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture_lines(table(spark, d, "corpus_files"), table(spark, d, "corpus_index"))


def p2_main_body(spark: SparkSession, d: str) -> DataFrame:
    """What the removal of the sites' templates leaves of each page."""
    body = main_body(table(spark, d, "corpus_files"), table(spark, d, "corpus_index"))
    return body.select("file", F.col("n_removed").cast("bigint").alias("n_removed"), F.length("body_text").cast("bigint").alias("n_chars"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(table(spark, d, "corpus_files"), table(spark, d, "corpus_index")).select("file", "line_no")


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many boilerplate blocks there are by their number of lines and the files of their most frequent line."""
    blocks = boilerplate_blocks(table(spark, d, "corpus_files"), table(spark, d, "corpus_index"))
    each = blocks.groupBy("block").agg(F.count("*").alias("n_lines"), F.max("n_files").alias("n_files"))
    return each.groupBy("n_lines", "n_files").agg(F.count("*").alias("n_blocks"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """What taking the repeated lines out leaves of each file."""
    clean = without_repeated_lines(table(spark, d, "corpus_files"), table(spark, d, "corpus_index"))
    return clean.select("file", F.col("n_removed").cast("bigint").alias("n_removed"), F.length("body_text").cast("bigint").alias("n_chars"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked and into how many documents."""
    found = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The words that cutting the leaked passages takes out of each document that has any."""
    clean = without_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return clean.where("n_words_removed > 0").select("doc_id", "n_words_removed")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0].select("doc_id", "source", "tokens", "copies")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    shares = ("mean_word_length", "symbols_per_word", "final_punctuation_lines", "bullet_lines", "ellipsis_lines", "alphabetic_words", "common_words")
    return text_statistics(table(spark, d, "documents")).select("doc_id", "n_words", "n_lines", *(F.round(x, 6).alias(x) for x in shares))


def p8_failures(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each document fails, and what most of it is."""
    return text_statistics(table(spark, d, "documents")).select("doc_id", F.round("prose_share", 6).alias("prose_share"), "failed", "run_rule", "shape")


QUERIES = {f.__name__: f for f in (p2_found, p2_main_body, p3_found, p3_blocks, p3_cleaned, p6_found, p6_leaked_items, p6_cleaned, p7_mix, p7_shares, p8_found, p8_statistics, p8_failures)}
