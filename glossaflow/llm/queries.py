"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html_model, jaccard_join, license_scan, oracles, paragraph_dedup, phrase_mining, pii, prefix_trie, quality_model, quality_rules, suffix_dedup, toxicity
from .common import documents, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start_word, common, answer) of the documents that hold a benchmark item."""
    found = decontamination.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("item", "item_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of token ids and of the decoded text of every document, a null text as an empty one."""
    return bpe.round_trip_digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    found = quality_rules.quality(documents(spark, sf_dir))
    return found.selectExpr("id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of every document."""
    return pii.spans(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and pieces that recur, with the occurrence that stays; documents without any have no row."""
    return paragraph_dedup.near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the lexicon learned from labels."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that occur again; documents without any have no row."""
    return suffix_dedup.repeated_spans(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by the model learned from pages that mark their article."""
    pages = table(spark, sf_dir, "pages")
    return html_model.extract(pages, html_model.train(pages)).withColumnRenamed("id", "page_id")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the factorisation machine learned from labels."""
    return quality_model.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the set and the component of every document."""
    return jaccard_join.similar_components(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence phrases and notices of every document."""
    return license_scan.licences(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language."""
    return phrase_mining.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html": op8_html,
    "op9_quality_model": op9_quality_model,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_licences": op11_licences,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": oracles.QUALITY_RULES,
    "op4_pii": oracles.PII,
    "op10_jaccard_join": oracles.JACCARD_JOIN,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_phrases": oracles.PHRASE_MINING,
}
