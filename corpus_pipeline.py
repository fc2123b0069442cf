"""The training-corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import line_dedup, near_dedup, packing, quality_rules, store, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("suffix dedup", suffixes), ("best-fit packing", pack)]

#: line, near and suffix decisions and the packing itself can't be put as DuckDB SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
