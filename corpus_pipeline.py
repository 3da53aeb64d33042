"""Pipeline over documents: quality rules, language, near-duplicates, benchmark leaks, packing.

Each stage takes the documents its predecessor kept, written as Parquet and read again, and returns
those it keeps with the columns of documents; the last returns the packed pieces. No stage can be
expressed in SQL as a whole (the language network is trained), so tests hold it against a
brute-force version.

Defined cases, by stage: documents without text (null, empty, blank) fail the quality rules; those
without a letter the language stage; of near copies the smallest doc_id stays, of repeated rows one, a
null doc_id only if its group has no other; documents that hold a benchmark item as a whole or in part
(decontam.py) go; texts of any length are judged and packed whole. An empty table gives empty stages.
Columns of documents are returned as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm import decontam, langid, packing, quality, simhash
from xylem.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
