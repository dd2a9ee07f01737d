"""From raw documents to packed training sequences: four stages, each on all that the one before kept.

Nulls, empty texts, repeated rows, empty tables and extra columns: see the operators. Rows whose doc_id is null are kept
by the join (they belong to no group), and rows of one id are kept or dropped together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, quality, suffix_dedup
from tessera.llm.common import Workspace
from tessera.llm.queries import WORD_BPE, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled ones among ``docs``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    kept = ngram_join.components(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi")
    return named.union(docs.where("doc_id is null")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that also start earlier go; n_chars follows the text."""
    return suffix_dedup.kept_text(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: SQL expresses neither the classifier's fit nor BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again as the next one's input."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name, large=True)
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["STAGES", "ORACLE_SQL", "run", "F"]
