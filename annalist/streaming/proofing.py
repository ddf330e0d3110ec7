"""Proofreading of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.operators.proofread import NARROW_RULES, proof_findings
from annalist.sources.tables import SCHEMAS


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of documents in a folder, as a stream."""
    return spark.readStream.schema(SCHEMAS["documents"]).parquet(folder)


def proof_stream(documents: DataFrame) -> DataFrame:
    """The rules that look at one document at a time; stateless, so append mode needs no watermark."""
    return proof_findings(documents, NARROW_RULES)
