"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Stash, table
from lectern.llm.decontam import drop_contaminated
from lectern.llm.langid import keep_identified
from lectern.llm.line_templates import dedup_lines
from lectern.llm.packing import pack
from lectern.llm.queries import vocabulary
from lectern.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ``lang`` is what its text tells; documents without one (null texts, texts without a letter) go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut from the texts; every document stays, with its new length."""
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a window of any benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences of 1024 tokens that the documents fill, each sequence of one language."""
    return pack(docs, vocabulary(), by="lang")


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, XXH64 and BPE have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs, stash = table(spark, sf_dir, "documents"), Stash(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stash.put(docs)
    return docs
