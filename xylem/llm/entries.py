"""Queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm import decontam, hosts, langid, licenses, ngram, packing, quality, simhash, tokens, warc
from xylem.llm.common import table


def op1_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.scores(table(spark, sf_dir, "documents"))


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.matrices(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_rnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op7_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judged(table(spark, sf_dir, "pages"))


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, from the stored bits of op8."""
    return quality.ablation(quality.stored(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentence_rules": op1_sentence_rules,
    "op2_ngram_trie": op2_ngram_trie,
    "op3_token_matrices": op3_token_matrices,
    "op4_warc": op4_warc,
    "op5_template_leaks": op5_template_leaks,
    "op6_byte_rnn": op6_byte_rnn,
    "op7_host_graph": op7_host_graph,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_simhash": op9_simhash,
    "op10_best_fit": op10_best_fit,
    "quality_ablation": quality_ablation,
}

ORACLE_SQL = {
    "op4_warc": warc.ORACLE,
    "op7_host_graph": hosts.oracle(),
    "op8_rule_ledger": quality.ORACLE,
    "quality_ablation": quality.ABLATION_ORACLE,
}
