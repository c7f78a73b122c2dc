"""A corpus pipeline of five of the text operators, each stage written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korvex.llm import common, decontaminate, jaccard_join, pieces, quality, secret_scan


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled ones of these documents."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate pairs connect, the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows the text. Words of good documents are fitted on."""
    return secret_scan.redact(docs, secret_scan.fit_on(docs, common.table(spark, sf_dir, "labels")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, n_chars, lossless) of the documents that are left."""
    return pieces.encode_documents(docs)


STAGES = [("quality", good_text), ("near duplicates", one_of_group), ("benchmark", no_benchmark), ("secrets", no_secrets), ("pieces", encoded)]

#: The trained classifier and the piece encoding aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. The stages' tables are written to the folder that the session's checkpoints use."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
