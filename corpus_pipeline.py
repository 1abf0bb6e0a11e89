"""Corpus pipeline: each stage reads what its predecessor kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, secret scans and best-fit packing are
applied in this order; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, decontamination, jaccard, packing, quality, secrets

ORACLE_SQL = None


# All stages: rows without a doc_id, repeated rows, null, empty and very long texts and empty tables are handled as each
# docstring says; further columns pass through, whatever their names, up to packing, which returns pieces.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores under 0.3.

    Null and empty texts have a score like any other, whole texts count, and repeated rows are judged alike; rows without a
    doc_id are scored but not learnt from. Without labels every score is 0.5, and all stay.
    """
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, only the document with the smallest doc_id stays.

    Null ids come last; of rows with one id, the smallest digest of the text. Texts without words, null ones too, are
    in no group, and all stay. Of repeats of a row that stays, one stays. A similarity of just 0.8 links.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which windows of benchmark items cover a twentieth or more.

    Texts without words, null ones too, stay. Repeated rows are judged alike, whatever their ids. An empty benchmark drops nothing.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; n_chars follows. Every document stays.

    Null texts stay null, with their n_chars; texts without secrets stay as they are. Repeated rows are masked alike.
    """
    return secrets.mask_secrets(docs, secrets.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: a row per piece.

    A null text is the empty one: a piece with the single id 0. Repeated rows and rows without a doc_id have pieces of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
